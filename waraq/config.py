"""Versioned configurations: frozen, strict about unknown keys, and with a fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Config:
    @classmethod
    def from_dict(cls, values: dict):
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"{cls.__name__} has no {sorted(unknown)}")
        return cls(**values)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps({"kind": type(self).__name__, **asdict(self)}, sort_keys=True, default=str).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Encoding(Config):
    version: str = "1"
    max_mojibake_rate: float = 0.001
    max_replacement_rate: float = 0.001
    max_control_rate: float = 0.001
    max_repair_passes: int = 3


@dataclass(frozen=True)
class Language(Config):
    version: str = "1"
    min_letters: int = 20
    mixed_min_ratio: float = 0.10
    min_margin: float = 0.02
    min_evidence: float = 0.08
    urdu_letter_weight: float = 4.0
    arabic_letter_weight: float = 2.0
    sentence_min_letters: int = 8
    running_text_rate: float = 0.5
    code_switch_min_share: float = 0.10
    alternation_min_share: float = 0.30


@dataclass(frozen=True)
class Quality(Config):
    version: str = "1"
    min_chars: int = 400
    min_words: int = 40
    max_dup_line_ratio: float = 0.50
    top_ngram: tuple = ((3, 0.26), (4, 0.22))
    dup_ngram: tuple = ((5, 0.60), (6, 0.58), (7, 0.56), (8, 0.54), (9, 0.52), (10, 0.50))
    max_url_ratio: float = 0.30
    max_html_ratio: float = 0.10
    max_replacement_rate: float = 0.001

    @classmethod
    def for_sentences(cls) -> Quality:
        return cls(min_chars=20, min_words=3, max_dup_line_ratio=1.0, top_ngram=((2, 1.0),), dup_ngram=())


@dataclass(frozen=True)
class NearDup(Config):
    version: str = "1"
    permutations: int = 128
    bands: int = 32
    rows: int = 4
    shingle_size: int = 5
    min_shingles: int = 8
    threshold: float = 0.80
    retain: float = 0.50
    seed: int = 0

    def band_threshold(self) -> float:
        """The similarity at which a pair is a candidate about half of the time."""
        return (1 / self.bands) ** (1 / self.rows)

    def candidate_probability(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


@dataclass(frozen=True)
class EvalSet(Config):
    """How one evaluation set is shingled and judged."""

    name: str
    shingle_size: int = 5
    shingle_unit: str = "word"
    min_shingles: int = 8
    containment: float = 0.80
    retain: float = 0.50
    min_line_chars: int = 40

    @classmethod
    def for_sentences(cls, name: str) -> EvalSet:
        """Single sentences have too few word shingles to measure: characters, and stricter limits."""
        return cls(name, shingle_unit="char", min_shingles=25, containment=0.90, retain=0.80)


@dataclass(frozen=True)
class Splits(Config):
    """Budgets are shares of a population's characters, so they suit any corpus size."""

    version: str = "1"
    salt: str = "splits-1"
    buckets: int = 100_000
    arms: tuple = (("A", 0.05), ("B", 0.20))
    heldout_share: float = 0.02


@dataclass(frozen=True)
class Budgets(Config):
    """Budgets in tokens: arms of the same mixture of populations, and two held-out sets; characters stand for tokens by measured ratios."""

    version: str = "1"
    salt: str = "splits-1"
    buckets: int = 100_000
    arms: tuple = (("A", 25_000_000), ("B", 85_000_000))
    targets: tuple = (("urdu", 80), ("roman_urdu", 15), ("code_switched", 5))
    chars_per_token: tuple = (("urdu", 3.5), ("roman_urdu", 4.2), ("code_switched", 3.8))
    heldout_sequences: int = 5_000
    sequence_length: int = 512
    sample_rate: float = 1.0

    def __post_init__(self) -> None:
        ratios = dict(self.chars_per_token)
        if not self.arms or not self.targets or min(n for _, n in (*self.arms, *self.targets)) <= 0:
            raise ValueError("budgets need arms and targets above 0")
        if any(ratios.get(p, 0) <= 0 for p, _ in self.targets) or not 0 < self.sample_rate <= 1:
            raise ValueError("each target needs its characters a token, and the sample rate is within 0 and 1")

    def share(self, population: str) -> float:
        """The part of every arm and held-out set that a population is."""
        return dict(self.targets)[population] / sum(n for _, n in self.targets)

    def chars(self, population: str, tokens: float) -> float:
        return tokens * self.share(population) * dict(self.chars_per_token)[population]

    def heldout_tokens(self) -> int:
        return self.heldout_sequences * self.sequence_length


@dataclass(frozen=True)
class Packing(Config):
    version: str = "1"
    sequence_length: int = 512
    eos: int = 256
    salt: str = "packing-1"
    sequences_per_shard: int = 20_000


@dataclass(frozen=True)
class Damage(Config):
    """Rates of damage, drawn for each document from a range, and shares of its kinds."""

    version: str = "2"
    ocr_rate: tuple = (0.01, 0.10)
    ocr_lossy_share: float = 0.5
    ocr_insert_share: float = 0.35
    drop_share: float = 0.4
    double_share: float = 0.3
    spacing_rate: tuple = (0.02, 0.12)
    spacing_join_share: float = 0.5
    switch_rate: tuple = (0.15, 0.45)

    def __post_init__(self) -> None:
        for name in ("ocr_rate", "spacing_rate", "switch_rate"):
            low, high = getattr(self, name)
            if not 0 <= low <= high <= 1:
                raise ValueError(f"{name} is not a range within 0 and 1")
