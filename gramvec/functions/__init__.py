"""Column -> Column building blocks (all built-in Spark expressions, no UDFs)."""

from gramvec.functions.hashing import fnv1a_bucket, hash_uniform, bucket_ids
from gramvec.functions.text import char_ngrams, clean_sentence_words, mark_sentences
from gramvec.functions.vectors import dot, l2_norm, normalize

__all__ = [
    "fnv1a_bucket",
    "hash_uniform",
    "bucket_ids",
    "char_ngrams",
    "clean_sentence_words",
    "mark_sentences",
    "dot",
    "l2_norm",
    "normalize",
]
