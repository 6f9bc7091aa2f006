"""Problem 1: texts over a size limit as consecutive pieces within it.

The offsets of the tokens (pieces between blanks) are the prefix sums of sizes; natural boundaries are sorted arrays of
token numbers, one for each strength. The end of a piece is found by binary search: the last token that fits by count
and by characters, then the last boundary of the strongest kind in the second half of that reach, and a cut between two
tokens where there is none. The next piece begins `overlap` tokens earlier. A single token over the limit is cut hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS, MAX_CHARS, OVERLAP = 300, 4000, 30

_TOKEN = re.compile(r"[^ \t\r\n]+")
_BREAK = re.compile(r"\r\n|\n|\r")
_SENTENCE_END = tuple(".!?:;。！？…")


def cut(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(from, to) of the pieces in characters. Nothing for a text of blanks only."""
    spans = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        spans += [(x, min(x + max_chars, b)) for x in range(a, b, max_chars)]
    if not spans:
        return []
    starts, ends = np.array(spans, np.int64).T
    n = len(starts)
    # Strength of the boundary before each token: 3 blank line or heading, 2 line, 1 sentence.
    strength = np.zeros(n, np.int8)
    breaks = np.array([m.start() for m in _BREAK.finditer(text)], np.int64)
    between = np.searchsorted(breaks, starts[1:]) - np.searchsorted(breaks, ends[:-1])
    strength[1:] = np.where(between >= 2, 3, np.where(between == 1, 2, 0))
    for i in range(1, n):
        if strength[i] == 2 and text[starts[i]] == "#":
            strength[i] = 3
        elif strength[i] == 0 and text[ends[i - 1] - 1] in _SENTENCE_END and ends[i - 1] < starts[i]:
            strength[i] = 1
    boundaries = [np.flatnonzero(strength >= s) for s in (3, 2, 1)]
    out, i, before = [], 0, 0
    while True:
        reach = min(i + max_words, int(np.searchsorted(ends, starts[i] + max_chars, "right")))  # first token that no longer fits
        if reach >= n:
            out.append((int(starts[i]), int(ends[-1])))
            return out
        at, least = reach, max(before + 1, i + (reach - i) // 2)  # behind the last cut
        for sorted_at in boundaries:
            k = int(np.searchsorted(sorted_at, reach, "right")) - 1
            if k >= 0 and sorted_at[k] >= least:
                at = int(sorted_at[k])
                break
        out.append((int(starts[i]), int(ends[at - 1])))
        before = at
        # The overlap, less where the next token wouldn't fit behind it.
        i = max(at - overlap, i + 1, int(np.searchsorted(starts, ends[at] - max_chars, "left")), at + 1 - max_words)


def split_oversized(df: DataFrame, key: str, text: str, line_start: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, n_pieces, text, words, chars, line_start) of each text with more than max_words pieces between blanks
    or more than max_chars characters; texts within the limits don't appear.

    Whether a text is too long is counted in the JVM, so only such texts go to Python; there is no shuffle, and each row
    is cut on its own. line_start counts LF, CR and CRLF as one line end each, from the row's own line_start, and is null
    where that is null. Null and empty texts aren't too long. An oversized text of blanks only gives one empty piece.
    Repeated rows give repeated pieces. Other columns are ignored.
    """
    if not 0 <= overlap < max_words or max_chars < 1:
        raise ValueError("overlap must be less than max_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, t, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pieces = cut(t, max_words, max_chars, overlap) or [(0, 0)]
                breaks = np.array([m.end() for m in _BREAK.finditer(t)], np.int64)
                for no, (a, b) in enumerate(pieces):
                    line_at = None if line is None else line + int(np.searchsorted(breaks, a, "right"))
                    rows.append((k, no, len(pieces), t[a:b], len(_TOKEN.findall(t, a, b)), b - a, line_at))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=[key, "piece", "n_pieces", "text", "words", "chars", "line_start"])

    long = (F.char_length(df[text]) > max_chars) | (
        (F.char_length(df[text]) > 2 * max_words) & (F.regexp_count(df[text], F.lit("[^ \\t\\r\\n]+")) > max_words)
    )
    kind = df.schema[key].dataType.simpleString()
    return (
        df.filter(long)
        .select(df[key], df[text], df[line_start].cast("int"))
        .mapInArrow(run, f"`{key}` {kind}, piece int, n_pieces int, text string, words int, chars int, line_start int")
    )
