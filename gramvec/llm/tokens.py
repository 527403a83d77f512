"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once per batch.

A tokenizer that drops white space gives a text the ids of its words one after
another, so a batch is split into words, the distinct words are encoded and
their ids are gathered back for every occurrence. Distinct words of plain
Latin letters are split once more into the runs that the tokenizer encodes one
by one; these share a bounded cache for the life of the Python worker. Any
other tokenizer, and any text that holds a special token, is encoded directly.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs that the cache may hold when a chunk begins; beyond this size it starts anew.
CACHE_RUNS = 200_000
#: Rows of a batch that are taken together, and characters that are encoded together.
SLICE_ROWS = 2_000
CHUNK_CHARS = 6_000_000

# Printable ASCII and the composed letters below U+0250; U+0130 is left out, as it is two characters in lower case.
_PLAIN = r"^[\x21-\x7eÀ-ÖØ-öø-įı-ɏ]*$"
# What the tokenizer takes for one word: a contraction, letters, one digit, or marks. Line ends part the words.
_RUNS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|\n|(?:[^\w\n]|_)+")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes lists of texts to flat id arrays; one per Python worker (see ``encoder``)."""

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer_path())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs: dict[str, bytes] = {}
        # The same model on runs in lower case, one by one, each byte shown as the byte-level alphabet has it.
        self.of_runs = Tokenizer(self.tokenizer.model)
        self.of_runs.pre_tokenizer = WhitespaceSplit()
        show = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: show.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}
        # Ids that end a run: the model marks them with its suffix for word ends.
        suffix, vocab = self.of_runs.model.end_of_word_suffix, self.of_runs.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.by_word = bool(suffix) and all(
            self._direct(t) == [i for w in t.split() for r in _RUNS.findall(w.lower()) for i in self._of_run(r)]
            for t in ["Ab, c's 12.x\n\nDé Éa", "x", "'S don't it's--", "Ab C"]
        )

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of_run(self, run: str) -> list[int]:
        return self.of_runs.encode(run.translate(self.shown), add_special_tokens=False).ids

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of text ``i`` are ``ids[offsets[i]:offsets[i + 1]]`` (uint32; None is empty)."""
        parts, counts, at = [], np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            ids, n = self._chunk([t or "" for t in texts[at:end]])
            parts.append(ids)
            counts[at:end] = n
            at = end
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), offsets

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = [not self.by_word or any(s in t for s in self.special) for t in texts]
        if all(alone):
            found = [np.array(self._direct(t), np.uint32) for t in texts]
            return np.concatenate(found), np.array([len(x) for x in found])
        spaced = pa.array(["" if a else t for t, a in zip(texts, alone)], pa.large_string())
        for space in "\n\t\r":
            spaced = pc.replace_substring(spaced, space, " ")
        words = pc.split_pattern(spaced, " ")
        del spaced
        per_text = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        del words
        ids, ends = gather(*self._distinct(coded.dictionary), coded.indices.to_numpy())
        bounds = ends[np.concatenate([[0], np.cumsum(per_text)])]
        counts = np.diff(bounds)
        if any(alone):
            pieces = [
                np.array(self._direct(texts[i]), np.uint32) if a else ids[bounds[i] : bounds[i + 1]]
                for i, a in enumerate(alone)
            ]
            return np.concatenate(pieces), np.array([len(x) for x in pieces])
        return ids, counts

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: one pool and the bounds of each word in it."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        found = _RUNS.findall("\n".join(strings(words.filter(pa.array(plain)))).lower() + "\n")
        coded = pa.array(found, pa.string()).dictionary_encode()
        del found
        kinds, index = strings(coded.dictionary), coded.indices.to_numpy()
        last = kinds.index("\n")
        ids, ends = gather(*pooled(self._runs(kinds)), index)
        starts = np.concatenate([[0], ends[1:][index == last]])[: int(plain.sum()) + 1]
        if plain.all():
            return ids, starts
        other = [np.array(self._direct(w), np.uint32) for w in strings(words.filter(pa.array(~plain)))]
        lens = np.empty(len(words), np.int64)
        lens[plain], lens[~plain] = np.diff(starts), [len(x) for x in other]
        pool = np.concatenate([ids, *other])
        at = np.empty(len(words), np.int64)
        at[plain], at[~plain] = starts[:-1], len(ids) + np.cumsum(lens[~plain]) - lens[~plain]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return pool[np.repeat(at - ends[:-1], lens) + np.arange(ends[-1])], ends

    def _runs(self, kinds: list[str]) -> list[bytes]:
        """Ids of distinct runs, from the cache or encoded now (the line end has none)."""
        runs = self.runs
        if len(runs) > CACHE_RUNS:
            runs.clear()
        runs["\n"] = b""
        new = [r for r in kinds if r not in runs]
        new.sort(key=str.isascii)  # those of ASCII letters together: they are shown as they are
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            found = self.of_runs.encode_batch_fast([" ".join(some).translate(self.shown)], add_special_tokens=False)[0]
            ids = np.array(found.ids, np.uint32)
            cut = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
            data = ids.tobytes()
            runs.update((r, data[4 * a : 4 * b]) for r, a, b in zip(some, cut[:-1], cut[1:], strict=True))
        return [runs[r] for r in kinds]


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def pooled(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``values`` one after another, and the bounds of each."""
    lens = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.frombuffer(b"".join(values), np.uint32), np.concatenate([[0], np.cumsum(lens)])


def gather(pool: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values ``pool[bounds[i]:bounds[i + 1]]`` for every i of ``index``, and the new bounds."""
    n = np.diff(bounds)[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    shift = (bounds[:-1][index] - ends[:-1]).astype(np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64)
    at = np.repeat(shift, n)
    at += np.arange(ends[-1], dtype=at.dtype)
    return pool[at], ends


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``SLICE_ROWS`` rows, so that a task holds the ids of few documents at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder for the tokenizer file at ``path`` (default: the public word BPE)."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

