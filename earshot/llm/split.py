"""Oversized texts into ordered, overlapping pieces, by pointer doubling over boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these.
WORD = r"[^ \t\r\n]+"


def word_count(text):
    """Column: number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def _boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offsets of the words, and the strength of the pause after each: 3 line end, 2 sentence, 1 clause, 0 none."""
    spans = np.array([m.span() for m in re.finditer(WORD, text)], dtype=np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0], spans[:, 1]
    strength = np.zeros(len(starts), dtype=np.int8)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        tail = text[s:e].rstrip("\"')]”’»")[-1:]
        strength[i] = 2 if tail in (".", "!", "?", "…") else 1 if tail in (",", ";", ":", "–", "—") else 0
        if i + 1 < len(starts) and "\n" in text[e : starts[i + 1]]:
            strength[i] = 3
    return starts, ends, strength


def _last_at_most(positions: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each limit the greatest of the sorted positions that isn't beyond it, or -1."""
    at = np.searchsorted(positions, limit, side="right") - 1
    return np.where(at >= 0, positions[np.maximum(at, 0)] if len(positions) else -1, -1)


def _cuts(strength: np.ndarray, size: int, overlap: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last word of each piece.

    Every word is a possible start; it is joined to its farthest legal end (the
    last line or sentence end within ``size`` words that still fills ``1 - slack``
    of a piece, else the last clause end, else the word limit) and from there to
    the start of the next piece, about ``overlap`` words back. Squaring that
    successor table log2(n) times, while the set of reached starts takes one more
    step of the doubled length each time, marks all starts of the greedy cutting
    without walking it.
    """
    n = len(strength)
    start = np.arange(n)
    far = np.minimum(start + size, n)
    floor = start + max(1, int(size * (1 - slack)))
    end = far.copy()
    for least in (1, 2):
        at = _last_at_most(np.flatnonzero(strength >= least) + 1, far)
        end = np.where((at >= floor) & (far < n), at, end)
    back = end - overlap
    opens = np.concatenate([[0], np.flatnonzero(strength >= 2) + 1])
    near = _last_at_most(opens, back + overlap // 2)
    nxt = np.where(near >= back - overlap // 2, near, back)
    nxt = np.where((end >= n), n, np.clip(nxt, start + 1, np.maximum(end, start + 1)))
    succ = np.append(nxt, n)
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = True
    for _ in range(max(1, int(n).bit_length())):
        reached[succ[reached]] = True
        succ = succ[succ]
    first = np.flatnonzero(reached[:n])
    return first, end[first]


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", size: int = 400, overlap: int = 50, slack: float = 0.4) -> DataFrame:
    """Pieces ``(id_col, piece_no, n_pieces, first_word, last_word, text)`` of every text of more than ``size`` words.

    Pieces number from 1, hold at most ``size`` words, are substrings of the text,
    and each begins about ``overlap`` words before the end of the one before (the
    nearest sentence start within half the overlap, else exactly ``overlap``).
    Null and empty texts and texts within the limit have no piece here; null ids
    are kept; repeated loads of an id (same id, same text) give one set of pieces.
    Only oversized rows leave the JVM and only they are shuffled, by their id.
    """
    if not 0 <= overlap < size * (1 - slack):
        raise ValueError("overlap must be less than the least fill of a piece")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.filter(F.length("text") > 2 * size).filter(word_count(F.col("text")) > size).dropDuplicates(["id", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                starts, ends, strength = _boundaries(text)
                a, b = _cuts(strength, size, overlap, slack)
                k = len(a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * k, batch.schema.field(0).type),
                        pa.array(range(1, k + 1), pa.int32()),
                        pa.array([k] * k, pa.int32()),
                        pa.array((a + 1).tolist(), pa.int32()),
                        pa.array(b.tolist(), pa.int32()),
                        pa.array([text[starts[i] : ends[j - 1]] for i, j in zip(a, b)], pa.string()),
                    ],
                    names=["id", "piece_no", "n_pieces", "first_word", "last_word", "text"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece_no int, n_pieces int, first_word int, last_word int, text string").withColumnRenamed("id", id_col)
