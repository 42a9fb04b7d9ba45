"""waraq: a PySpark-native engine for curating and analysing large multilingual text corpora."""
