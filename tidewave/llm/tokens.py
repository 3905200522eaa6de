"""Token ids of whole texts, by the tokenizers library.

Used by tasks on Arrow batches. A text's ids are the concatenation of the ids
of its runs between ASCII white space, for the tokenizer drops white space and
no token spans it. Runs repeat, so each worker process keeps those that it has
encoded; the memory for that has a bound, and reaching it only costs time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Runs kept by a worker process.
CACHE_RUNS = 2_000_000
#: Characters of text encoded at once.
SLICE_CHARS = 4_000_000
#: Runs that lower-casing and NFC leave as long as they are; the rest are encoded one by one.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"


class WordEncoder:
    """Encodes arrays of texts with a tokenizer that marks the end of a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.runs = pa.array([], pa.large_string())
        self.keys = np.zeros(0, np.uint64)  # hashes of runs, ascending, and the places of the runs
        self.places = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and len(texts) + 1 offsets. Null: no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        known = self._lookup(coded.dictionary)
        lengths = np.diff(self.offsets)[known]
        starts = self.offsets[known]
        at = coded.indices.to_numpy()
        n, first = lengths[at], starts[at]
        done = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(done[-1]) + np.repeat(first - done[:-1], n)
        return self.ids[take], done[split.offsets.to_numpy()]

    def _lookup(self, runs: pa.Array) -> np.ndarray:
        if len(self.runs) + len(runs) > CACHE_RUNS:
            self.forget()
        h = pd.util.hash_array(runs.to_numpy(zero_copy_only=False), categorize=False)
        known = np.full(len(runs), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            same = np.flatnonzero(self.keys[at] == h)
            place = self.places[at[same]]
            # runs of one hash that differ are not known
            equal = pc.equal(self.runs.take(pa.array(place)), runs.take(pa.array(same))).to_numpy(zero_copy_only=False)
            known[same[equal]] = place[equal]
        new = np.flatnonzero(known < 0)
        if len(new):
            ids, lengths = self._encode_runs(runs.take(pa.array(new)))
            known[new] = np.arange(len(self.runs), len(self.runs) + len(new))
            self.runs = pa.concat_arrays([self.runs, runs.take(pa.array(new))])
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            keys, first = np.unique(h[new], return_index=True)
            at = np.searchsorted(self.keys, keys)
            fresh = np.append(self.keys, np.uint64(0))[at] != keys if len(self.keys) else np.ones(len(keys), bool)
            fresh |= at == len(self.keys)
            self.keys = np.insert(self.keys, at[fresh], keys[fresh])
            self.places = np.insert(self.places, at[fresh], known[new[first[fresh]]])
        return known

    def _encode_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain runs are encoded many at a time: each of their words ends with
        an id that marks an end, so counting words finds the runs again."""
        plain = pc.match_substring_regex(runs, PLAIN)
        for word in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(runs, word)))
        plain = plain.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(runs), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if plain.any():
            where = np.flatnonzero(plain)
            words = runs.filter(pa.array(plain))
            # the words that the tokenizer's own pattern finds
            count = pc.count_substring_regex(pc.utf8_lower(words), r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").to_numpy()
            listed = words.to_pylist()
            lines = [" ".join(listed[i : i + 256]) for i in range(0, len(listed), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            after = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(after) - 1 != count.sum() or after[-1] != len(ids):
                raise ValueError("the tokenizer splits words in another way than expected")
            bounds = after[np.concatenate([[0], np.cumsum(count)])]
            lengths[where] = np.diff(bounds)
            parts.append((where, ids))
        if not plain.all():
            where = np.flatnonzero(~plain)
            each = [e.ids for e in self.tokenizer.encode_batch_fast(runs.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
            lengths[where] = [len(x) for x in each]
            parts.append((where, np.array([i for x in each for i in x], np.uint32)))
        out = np.empty(lengths.sum(), np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for where, ids in parts:
            n = lengths[where]
            done = np.cumsum(n) - n
            out[np.arange(len(ids)) + np.repeat(starts[where] - done, n)] = ids
        return out, lengths


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of text; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def word_bpe_path() -> str:
    """The tokenizer file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
