"""Problem 7: byte-level BPE ids of a corpus, by a hierarchical-bitmap rank queue.

Merging works on a doubly linked list of parts. For each merge rank that some adjacent pair has, a bucket holds the left
positions of such pairs; a two-level bitmap over the ranks (64 ranks a word, one summary bit a word) gives the lowest
occupied rank by find-first-set. Positions whose pair changed after they were put in are stale and skipped when their
bucket is emptied. Every merge costs constant work whatever the length of the pre-token, so a pre-token of a million
characters takes time in proportion to its length.

Pre-tokens recur, so each Python worker keeps the packed ids of those it has met, across batches and tasks.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Vocabulary file of the tokenizer, as ranks.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pre-tokens that a worker keeps; when full, the store starts anew.
CACHE_ENTRIES = 300_000


def _ranges(of) -> str:
    """A character class of all code points for which of() holds."""
    out, start, last = [], None, None
    for c in range(0x32000):  # beyond, there are no numbers
        if of(chr(c)):
            if start is None:
                start = c
            last = c
        elif start is not None:
            out.append((start, last))
            start = None
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: The white space of Unicode, as pre-tokenizers understand \s.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pretoken_pattern() -> re.Pattern:
    """The pre-token pattern of this vocabulary family, with the classes of letters and numbers written out for re.
    Letters are word characters other than _ and numbers; numbers are the categories Nd, Nl and No."""
    other = _ranges(lambda c: unicodedata.category(c) in ("Nl", "No"))
    letter, number = rf"[^\W\d_{other}]", rf"[\d{other}]"
    sign = rf"(?:[^\w{_SPACE}{other}]|_)"
    return re.compile(rf" ?{letter}+|'(?:[sdmt]|ll|ve|re)| ?{number}+| ?{sign}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


#: White space with the run of other characters after it. No pre-token reaches over the end of such a chunk.
_CHUNK = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_IS_SPACE = re.compile(rf"[{_SPACE}]").match


class _Store(dict):
    """A dict that makes what it lacks, and starts anew when full. Very long keys hardly recur and aren't kept."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) < 200:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class _Pairs(dict):
    """a << 20 | b -> the id that ids a and b merge to, or -1. Ids are ranks, in the order of the file."""

    def __init__(self, ranks: dict[bytes, int], pieces: list[bytes]) -> None:
        super().__init__()
        self.ranks, self.pieces = ranks, pieces

    def __missing__(self, key: int) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[key] = rank = self.ranks.get(self.pieces[key >> 20] + self.pieces[key & 0xFFFFF], -1)
        return rank


class Encoder:
    """Text -> its ids packed as 32-bit integers. Pre-tokens, chunks (see _CHUNK) and the pieces between single blanks
    are kept once encoded; most of a text is then put together from pieces without running the pattern."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as f:
            self.ranks = dict(sorted(((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)), key=lambda x: x[1]))
        if list(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError(f"{vocabulary}: ranks must be 0, 1, 2 and so on")
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = _Pairs(self.ranks, list(self.ranks))
        self.find = pretoken_pattern().findall
        self.of_token, self.of_chunk, self.of_spaced = _Store(self._token), _Store(self._chunk), _Store(self._spaced)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue is inlined: buckets (rank -> left positions), words (64 ranks each) and summary (a bit for each
        occupied word)."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        ids, pairs = [self.single[b] for b in raw], self.pairs
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        summary = 0
        fresh = list(enumerate(map(pairs.__getitem__, [a << 20 | b for a, b in zip(ids, ids[1:])])))
        while True:
            for i, rank in fresh:
                if rank >= 0:
                    if rank in buckets:
                        buckets[rank].append(i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> 6
                        words[word] = words.get(word, 0) | 1 << (rank & 63)
                        summary |= 1 << word
            if not summary:
                return [x for x in ids if x >= 0]
            word = (summary & -summary).bit_length() - 1  # find first set, in the summary and then in its word
            bits = words[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            words[word] = bits = bits & (bits - 1)
            if not bits:
                summary &= summary - 1
            # Left to right, as equal pairs merge. A merge can't make its own rank again, as pieces only grow.
            fresh = []
            for i in sorted(buckets.pop(rank)):
                x, j = ids[i], right[i]
                if x < 0 or j >= n or pairs[x << 20 | ids[j]] != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                right[i] = k = right[j]
                if k < n:
                    left[k] = i
                    fresh.append((i, pairs[rank << 20 | ids[k]]))
                h = left[i]
                if h >= 0:
                    fresh.append((h, pairs[ids[h] << 20 | rank]))

    def _token(self, word: str) -> bytes:
        return np.array(self.merge(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.of_token.__getitem__, self.find(chunk)))

    def _spaced(self, piece: str) -> bytes:
        """Of a piece after one blank. LookupError where that blank may belong to a longer run of white space."""
        if not piece or _IS_SPACE(piece[0]) or _IS_SPACE(piece[-1]):
            raise LookupError
        return self.of_chunk[" " + piece]

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not _IS_SPACE(first[-1]):
            try:
                return self._chunk(first) + b"".join(map(self.of_spaced.__getitem__, rest))
            except LookupError:
                pass
        return b"".join(map(self.of_chunk.__getitem__, _CHUNK.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """This process's encoder for the vocabulary: of the file where it lies, else of the copy that shipped() sent."""
    if vocabulary not in _ENCODERS:
        there = os.path.exists(vocabulary)
        _ENCODERS[vocabulary] = Encoder(vocabulary if there else SparkFiles.get(os.path.basename(vocabulary)))
    return _ENCODERS[vocabulary]


def shipped(docs: DataFrame, vocabulary: str) -> str:
    """Sends the vocabulary file to the executors, once a session, so that it must lie on the driver only."""
    sc = docs.sparkSession.sparkContext
    sent = sc.__dict__.setdefault("_docloom_files", set())
    if vocabulary not in sent and os.path.exists(vocabulary):
        sc.addFile(vocabulary)
        sent.add(vocabulary)
    return vocabulary


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each text without special tokens, one output row per input row, without a shuffle. Null
    and empty texts give an empty list. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(vocabulary).packed
        for batch in batches:
            parts = [make(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    shipped(docs, vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, *keep, n_tokens): like encode_corpus with the number of ids only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(vocabulary).packed
        for batch in batches:
            n = pa.array([len(make(t)) // 4 for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[key, *keep, "n_tokens"])

    shipped(docs, vocabulary)
    columns = [docs[c] for c in (key, *keep)]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(docs[text].cast("string"), *columns).mapInArrow(run, f"{schema}, n_tokens bigint")
