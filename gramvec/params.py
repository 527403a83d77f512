"""Job parameters with validation, checked before any job starts."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

# Defaults and bounds that must equal the original trainer's.
DEFAULTS = dict(
    steps=500001,
    vocabulary_size=50000,
    batch_size=128,
    embedding_size=300,
    skip_window=5,
    num_sampled=5,
    ngram_size=3,
    num_buckets=200000,
    learnrate=0.1,
    rejection_threshold=0.0001,
    num_batch_files=1,
    language="german",
    validation_words="",
)
VOCABULARY_SIZE_MAX = 10251098
NGRAM_SIZE_RANGE = (3, 6)
LEARNRATE_RANGE = (0.01, 1.0)
LOSS_REPORT_EVERY = 2000
LANGUAGES = ("german", "english", "french", "spanish", "de", "en", "fr", "es")


@dataclass
class Params:
    """All settings of preprocessing, training and inference.

    ``seed`` keys every random draw; ``passes`` is the number of passes over the
    pairs (the original's 0 = forever is rejected: rounds are explicit in ``fit``).
    ``query_ngram_size`` is the n used for query words; ``None`` means the
    training ``ngram_size`` (set 2 to reproduce the original's inference).
    """

    steps: int = DEFAULTS["steps"]
    vocabulary_size: int = DEFAULTS["vocabulary_size"]
    batch_size: int = DEFAULTS["batch_size"]
    embedding_size: int = DEFAULTS["embedding_size"]
    skip_window: int = DEFAULTS["skip_window"]
    num_sampled: int = DEFAULTS["num_sampled"]
    ngram_size: int = DEFAULTS["ngram_size"]
    num_buckets: int = DEFAULTS["num_buckets"]
    learnrate: float = DEFAULTS["learnrate"]
    rejection_threshold: float = DEFAULTS["rejection_threshold"]
    num_batch_files: int = DEFAULTS["num_batch_files"]
    language: str = DEFAULTS["language"]
    validation_words: str = DEFAULTS["validation_words"]
    seed: int = 42
    passes: int = 1
    count_empty: bool = True
    query_ngram_size: int | None = None
    negative_oversample: int = 8

    def __post_init__(self):
        self.validate()

    # -- validation -----------------------------------------------------
    def validate(self) -> "Params":
        def at_least(name, lo):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or v < lo:
                raise ValueError(f"{name} must be an integer >= {lo}, got {v!r}")

        at_least("steps", 1)
        at_least("batch_size", 1)
        at_least("embedding_size", 1)
        at_least("skip_window", 1)
        at_least("num_sampled", 1)
        at_least("num_batch_files", 1)
        at_least("passes", 1)
        at_least("negative_oversample", 1)
        # the original accepts 1 and then divides by zero; bucket 0 is padding
        at_least("num_buckets", 2)
        at_least("vocabulary_size", 1)
        if self.vocabulary_size > VOCABULARY_SIZE_MAX:
            raise ValueError(f"vocabulary_size must be <= {VOCABULARY_SIZE_MAX}")
        if self.num_buckets - 1 >= 2**31:
            raise ValueError("num_buckets must be < 2**31 + 1")
        lo, hi = NGRAM_SIZE_RANGE
        if not (lo <= self.ngram_size <= hi):
            raise ValueError(f"ngram_size must be in {lo}..{hi}")
        if self.query_ngram_size is not None and self.query_ngram_size < 1:
            raise ValueError("query_ngram_size must be >= 1")
        lo, hi = LEARNRATE_RANGE
        if not (lo <= float(self.learnrate) <= hi):
            raise ValueError(f"learnrate must be in {lo}..{hi}")
        if not (0 < float(self.rejection_threshold) <= 1):
            raise ValueError("rejection_threshold must be in (0, 1]")
        if self.num_sampled > self.vocabulary_size:
            raise ValueError("num_sampled must not exceed vocabulary_size")
        if str(self.language).lower() not in LANGUAGES:
            raise ValueError(f"language must be one of {LANGUAGES}")
        return self

    # -- derived ----------------------------------------------------------
    @property
    def validation_words_list(self) -> list[str] | None:
        if not self.validation_words:
            return None
        return [w for w in self.validation_words.split(",")]

    @property
    def effective_query_ngram_size(self) -> int:
        return self.query_ngram_size if self.query_ngram_size is not None else self.ngram_size

    def replace(self, **kw) -> "Params":
        return dataclasses.replace(self, **kw)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)
