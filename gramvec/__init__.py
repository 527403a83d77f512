"""gramvec: subword (character n-gram) skip-gram embeddings as Spark DataFrame jobs.

Every stage is a DataFrame operator: text is cleaned and split with built-in
regular expressions, words are counted and ranked with aggregations and a
distributed global ordinal, skip-gram pairs come from array slices, random
draws are keyed md5 uniforms (reproducible and checkable in SQL), and
training runs in rounds of per-shard SGD whose deltas are averaged by key.
"""

from gramvec.params import Params

__all__ = ["Params"]
