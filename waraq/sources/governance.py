"""What a source's licence allows, asks for and passes on, and who a source is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Licences, and whether they allow derivatives and commercial use, ask for attribution, and pass themselves on.
LICENCES = """
ODC-By-1.0 yes yes yes no
Apache-2.0 yes yes yes no
CC0-1.0 yes yes no no
CC-BY-4.0 yes yes yes no
CC-BY-SA-3.0 yes yes yes yes
CC-BY-SA-4.0 yes yes yes yes
CC-BY-NC-4.0 yes no yes no
CC-BY-NC-ND-4.0 no no yes no
"""


def licences(spark: SparkSession) -> DataFrame:
    """(licence, derivatives, commercial, attribution, share_alike)."""
    rows = [(name, *(x == "yes" for x in flags)) for name, *flags in map(str.split, LICENCES.strip().splitlines())]
    return spark.createDataFrame(rows, "licence string, derivatives boolean, commercial boolean, attribution boolean, share_alike boolean")


def judged(sources: DataFrame, terms: DataFrame) -> DataFrame:
    """sources with verdict: ok, unknown_licence, no_derivatives or no_commercial_use. sources: (source, licence, ..)."""
    j = sources.join(terms, "licence", "left")
    verdict = F.when(F.col("derivatives").isNull(), "unknown_licence").when(~F.col("derivatives"), "no_derivatives").when(~F.col("commercial"), "no_commercial_use").otherwise("ok")
    return j.withColumn("verdict", verdict)


def eligible(docs: DataFrame, sources: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents of sources that may be trained on; a source that isn't listed may not."""
    return docs.join(judged(sources, terms).filter(F.col("verdict") == "ok").select("source").distinct(), "source", "left_semi")


def attribution(sources: DataFrame, terms: DataFrame) -> DataFrame:
    """(source, licence, share_alike) of the sources that must be named."""
    return judged(sources, terms).filter((F.col("verdict") == "ok") & F.col("attribution")).select("source", "licence", "share_alike")


def problems(sources: DataFrame) -> DataFrame:
    """(source, problem): names that occur twice or are missing, and revisions that aren't pinned. sources: (source, revision, ..)."""
    twice = sources.groupBy("source").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("source").isNotNull()).select("source", F.lit("duplicate").alias("problem"))
    loose = sources.filter(~F.coalesce(F.col("revision"), F.lit("")).rlike("^[0-9a-f]{40}$|^[0-9a-f]{64}$")).select("source", F.lit("revision").alias("problem"))
    return twice.unionByName(loose).unionByName(sources.filter(F.col("source").isNull()).select("source", F.lit("name").alias("problem")))


def identity(files: DataFrame) -> DataFrame:
    """(source, files, bytes, fingerprint): the same for the same files in any order. files: (source, path, size, sha256).

    The fingerprint is a sum of digests of the rows, so no source's files come together in one place.
    """
    row = F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), "sha256"), 256)
    part = lambda first: F.pmod(F.sum(F.conv(F.substring(row, first, 15), 16, 10).cast("decimal(38,0)")), F.lit(1 << 60).cast("decimal(38,0)"))
    sums = files.distinct().groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), part(1).alias("x"), part(16).alias("y"))
    return sums.select("source", "files", "bytes", F.concat(F.lower(F.lpad(F.hex(F.col("x").cast("bigint")), 15, "0")), F.lower(F.lpad(F.hex(F.col("y").cast("bigint")), 15, "0"))).alias("fingerprint"))
