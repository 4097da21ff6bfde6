"""Held-out passages inside a corpus: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.wordhash import alnum_table, code_points, slices
from earshot.storage import measured_bytes, stage

#: Characters of a q-gram.
Q = 12
#: Bytes of items up to which all of them are sent to every task; beyond, documents and items meet by their q-grams first.
ITEM_BYTES = 16_000_000
#: Bits of the table that says which q-grams can occur at all.
FILTER_BITS = 22


def normal_text(text: str) -> str:
    """The words (letters and digits, lower case) with one blank between."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def _qgrams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams at every position of the normal forms of all texts, and each text's first position. Grams across two texts match nothing: a text ends in a line end."""
    cp, at = code_points(texts)
    inside = table[cp]
    final = np.zeros(len(cp), dtype=bool)
    final[at[1:] - 1] = True
    before = np.concatenate([[False], inside[:-1]])
    begins = np.concatenate([[True], final[:-1]])
    keep = inside | (before & ~begins) | final
    norm = np.where(inside, cp, np.where(final, np.uint32(10), np.uint32(32)))[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[at]
    if len(norm) < Q:
        return np.zeros(0, np.uint32), first
    h1 = (norm + np.uint32(1)) * np.uint32(0x9E3779B1)
    h1 ^= h1 >> np.uint32(15)
    h2 = h1[:-1] * np.uint32(0x85EBCA6B) + h1[1:]  # each doubles the stretch it stands for
    h4 = h2[:-2] * np.uint32(0xC2B2AE35) + h2[2:]
    h8 = h4[:-4] * np.uint32(0x27D4EB2F) + h4[4:]
    h = h8[: len(norm) - Q + 1] * np.uint32(0x165667B1) + h4[8:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h, first


def _banded(a: str, b: str, centre: int, width: int) -> int:
    """Edit distance of two strings over the cells within ``width`` of the diagonal ``centre`` (b index minus a index); free ends in b."""
    far = len(a) + len(b)
    row = {j: 0 for j in range(max(0, centre - width), min(len(b), centre + width) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i + centre - width), min(len(b), i + centre + width) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, row.get(j - 1, far) + (x != b[j - 1]), new.get(j - 1, far) + 1)
            new[j] = best
        row = new or {0: far}
    return min(row.values(), default=far)


def _windows(words: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of every run of ``min_words`` words in the normal form."""
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return (starts[: len(words) - min_words + 1], ends[min_words - 1 :]) if len(words) >= min_words else (starts[:0], ends[:0])


def _whole_words(doc: str, item: str, at_doc: int, at_item: int, length: int) -> tuple[int, int]:
    """Words that lie whole, in both strings, within an equal stretch: (how many, first character in doc). None where only the hashes were equal."""
    length = min(length, len(doc) - at_doc, len(item) - at_item)  # the q-grams also know the blank behind a last word
    if doc[at_doc : at_doc + length] != item[at_item : at_item + length]:
        return 0, at_doc
    end_doc, end_item, begin = at_doc + length, at_item + length, at_doc
    whole = (at_doc == 0 or doc[at_doc - 1] == " ") and (at_item == 0 or item[at_item - 1] == " ")
    if not whole:
        begin = doc.find(" ", at_doc, end_doc) + 1
        if not begin:
            return 0, at_doc
    stop = end_doc
    if not ((end_doc >= len(doc) or doc[end_doc] == " ") and (end_item >= len(item) or item[end_item] == " ")):
        stop = doc.rfind(" ", begin, end_doc)
    return (len(doc[begin:stop].split()), begin) if stop > begin else (0, begin)


class _Index:
    """The q-grams of some items, sorted, with what is needed to verify a region."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, edits: int):
        self.items, self.min_words, self.edits = items, min_words, edits
        self.table = alnum_table()
        self.normal = [normal_text(t) for _, t in items]
        self.windows = [_windows(n.split(" "), min_words) for n in self.normal]
        self.span = np.array([int((b - a).min()) if len(a) else 0 for a, b in self.windows], dtype=np.int64)
        grams, at = _qgrams([t for _, t in items], self.table)
        owner = np.repeat(np.arange(len(items)), np.diff(at))[: len(grams)]
        offset = np.arange(len(grams)) - at[owner]
        inside = (offset + Q <= np.array([len(n) for n in self.normal], dtype=np.int64)[owner]) & (self.span[owner] > 0)
        order = np.argsort(grams[inside], kind="stable")
        self.grams, self.owner, self.offset = grams[inside][order], owner[inside][order], offset[inside][order]
        self.possible = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.possible[self.grams & np.uint32((1 << FILTER_BITS) - 1)] = True
        self.need = np.maximum(self.span + 1 - Q - edits * Q, 1)
        self.width = 2 * edits + 2

    def _equal(self, texts: list[str], doc: np.ndarray, item: np.ndarray, pos: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """(text, item, (run_words, first_word, 0)) of the longest equal stretch of each pair that holds enough whole words."""
        pair, diagonal = doc.astype(np.int64) * len(self.items) + item, pos - place
        by = np.lexsort((pos, diagonal, pair))
        new = (np.diff(pair[by]) != 0) | (np.diff(diagonal[by]) != 0) | (np.diff(pos[by]) != 1)
        cut = np.flatnonzero(np.concatenate([[True], new, [True]]))
        first, length = by[cut[:-1]], np.diff(cut) + Q - 1
        best: dict[int, tuple[int, int, int]] = {}
        memo: dict[int, str] = {}
        for k in np.flatnonzero(length >= self.span[item[first]]):
            r = first[k]
            d, i = int(doc[r]), int(item[r])
            if d not in memo:
                memo[d] = normal_text(texts[d])
            words, begin = _whole_words(memo[d], self.normal[i], int(pos[r]), int(place[r]), int(length[k]))
            if words >= self.min_words and words > best.get(int(pair[r]), (0, 0, 0))[0]:
                best[int(pair[r])] = (words, memo[d].count(" ", 0, begin), 0)
        for code, v in best.items():
            yield *divmod(code, len(self.items)), v

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, run_words, first_word, edits) of the verified regions."""
        items, normal, windows, span, grams, need, width, edits, min_words = self.items, self.normal, self.windows, self.span, self.grams, self.need, self.width, self.edits, self.min_words
        out: list[tuple] = []
        for lo, hi in slices(texts):
            doc_grams, first = _qgrams(texts[lo:hi], self.table)
            hit = np.flatnonzero(self.possible[doc_grams & np.uint32((1 << FILTER_BITS) - 1)])
            left = np.searchsorted(grams, doc_grams[hit], side="left")
            count = np.searchsorted(grams, doc_grams[hit], side="right") - left
            hit, left, count = hit[count > 0], left[count > 0], count[count > 0]
            if not len(hit):
                continue
            entry = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pos = np.repeat(hit, count)
            doc = np.searchsorted(first, pos, side="right") - 1
            pos = pos - first[doc]
            item, place = self.owner[entry], self.offset[entry]
            diagonal = pos - place
            if not edits:  # the band is one diagonal, and the bound is reached by neighbouring grams only
                out += [(lo + d, i, *v) for d, i, v in self._equal(texts[lo:hi], doc, item, pos, place)]
                continue
            # Each gram counts in two bands of 2 * width diagonals, which overlap by half: a region that drifts by up to the width lies whole in one.
            band = np.concatenate([diagonal // width, diagonal // width - 1])
            pair = np.tile(doc.astype(np.int64) * len(items) + item, 2)
            by = np.lexsort((band, pair))
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(pair[by]) != 0) | (np.diff(band[by]) != 0)]))
            bounds = np.append(edge, len(by))
            enough = np.flatnonzero(np.diff(bounds) >= need[pair[by[edge]] % len(items)])
            memo: dict[int, str] = {}
            exact: dict[int, tuple[int, int, int]] = {}
            inexact: dict[int, list] = {}
            for g in enough:
                rows = by[bounds[g] : bounds[g + 1]]
                code = int(pair[rows[0]])
                d, i = divmod(code, len(items))
                rows = rows % len(pos)
                rows = rows[np.lexsort((pos[rows], diagonal[rows]))]
                a, b = windows[i]
                seen = np.unique(place[rows])
                shared = np.searchsorted(seen, b - Q, side="right") - np.searchsorted(seen, a)
                fits = np.flatnonzero(shared >= np.maximum(b - a + 1 - Q - edits * Q, 1))
                if not len(fits):
                    continue
                if d not in memo:
                    memo[d] = normal_text(texts[lo + d])
                p, g2 = pos[rows], diagonal[rows]
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(g2) != 0) | (np.diff(p) != 1), [True]]))
                length = np.diff(cut) + Q - 1
                for k in np.flatnonzero(length >= span[i]):
                    r = rows[cut[k]]
                    words, begin = _whole_words(memo[d], normal[i], int(pos[r]), int(place[r]), int(length[k]))
                    if words > exact.get(code, (0, 0, 0))[0]:
                        exact[code] = (words, memo[d].count(" ", 0, begin), 0)
                inexact.setdefault(code, []).extend((int(-shared[w]), int(a[w]), int(b[w]), int(np.median(g2))) for w in fits)
            for code, tries in inexact.items():
                d, i = divmod(code, len(items))
                if exact.get(code, (0, 0, 0))[0] >= min_words:
                    continue
                for _, a, b, g in sorted(set(tries)):
                    begin = max(0, a + g - width)
                    distance = _banded(normal[i][a:b], memo[d][begin : b + g + width + 1], a + g - begin, width)
                    if distance <= edits:
                        exact[code] = (exact.get(code, (0, 0, 0))[0], memo[d].count(" ", 0, max(0, a + g)), distance)
                        break
                else:
                    exact.pop(code, None)
            out += [(lo + c // len(items), c % len(items), *v) for c, v in exact.items() if v[0] >= min_words or v[2]]
        return out


_FOUND = ("run_words", "first_word", "edits")


def _rows(ids: pa.Array, items: list[tuple[int, str]], out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array([o[0] for o in out], pa.int64())), pa.array([items[o[1]][0] for o in out], pa.int64()), *(pa.array([o[k] for o in out], pa.int32()) for k in (2, 3, 4))], names=["doc_id", "item_id", *_FOUND]
    )


def _scan(df: DataFrame, items: list[tuple[int, str]], min_words: int, edits: int) -> DataFrame:
    """Verified regions of all items over all documents, which stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(items, min_words, edits)
        for batch in batches:
            yield _rows(batch.column(0), items, index.regions(batch.column(1).to_pylist()))

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, item_id bigint, run_words int, first_word int, edits int")


def _samples(df: DataFrame, window: int) -> DataFrame:
    """``(key, gram)``: the least q-gram of every ``window`` neighbouring ones of each text; two texts with as many equal neighbours share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = alnum_table()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                grams, first = _qgrams(texts[lo:hi], table)
                owners, kept = [], []
                for i in range(hi - lo):
                    g = grams[first[i] : max(first[i], first[i + 1] - Q)]
                    if len(g) < window:
                        continue
                    g = np.unique(np.lib.stride_tricks.sliding_window_view(g, window).min(1))
                    owners += [lo + i] * len(g)
                    kept.append(g)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owners, pa.int64())), pa.array(np.concatenate(kept).astype(np.int64) if kept else np.zeros(0, np.int64))], names=["key", "gram"])

    return df.mapInArrow(run, "key bigint, gram bigint")


def _meet(corpus: DataFrame, asked: DataFrame, min_words: int, edits: int) -> DataFrame:
    """As ``_scan`` for any number of items: documents and items that share a sampled q-gram are shuffled together, and each pair is verified."""
    window = max(1, 2 * min_words - Q - edits * Q)  # q-grams that the shortest possible region shares in a row
    docs = stage(corpus.withColumn("key", F.xxhash64("doc_id", "text")))
    items = stage(asked.toDF("item_id", "item").withColumn("item_key", F.xxhash64("item_id", "item")))
    a = _samples(docs.select("key", "text"), window).toDF("doc_key", "gram")
    b = _samples(items.select("item_key", "item"), window).toDF("item_key", "gram")
    pairs = a.join(b, "gram").select("doc_key", "item_key").distinct()
    pairs = pairs.join(items, "item_key").join(docs.select(F.col("key").alias("doc_key"), "doc_id", "text"), "doc_key").select("doc_id", "text", "item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, items = (batch.column(i).to_pylist() for i in (1, 2, 3))
            groups: dict[tuple[int, str], list[int]] = {}
            for i, item in enumerate(zip(ids, items)):
                groups.setdefault(item, []).append(i)
            out = [(same[r[0]], same[0], *r[2:]) for item, same in groups.items() for r in _Index([item], min_words, edits).regions([texts[i] for i in same])]
            yield _rows(batch.column(0), list(zip(ids, items)), out)

    return pairs.mapInArrow(run, f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, item_id bigint, run_words int, first_word int, edits int")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, edits: int = 1, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(doc_id, item_id, run_words, first_word, edits)``: every document region that holds ``min_words`` words of an item within ``edits`` characters.

    A region of n characters with at most k edits shares at least n + 1 - q - k * q
    q-grams with the passage, all on diagonals at most k apart. So shared grams are
    counted in overlapping bands of diagonals, regions that reach the bound for
    the item's shortest run of ``min_words`` words are kept, and these are aligned
    within the band, unless an equal stretch already holds enough whole words.
    ``run_words`` is the longest run of equal words (0 if only the alignment was
    good enough), ``first_word`` its place in the document (from 0).

    With ``edits`` 0 only equal stretches count, and nothing is aligned. Documents
    stay where they are while the items take at most ``item_bytes``; more items and
    documents are first joined on sampled q-grams (the least of as many neighbours as
    the shortest region shares), so the corpus is read once whatever their number;
    the result is the same. Null ids and texts take no part; items of fewer than
    ``min_words`` words match nothing; of items under one id each counts.
    """
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).dropna()
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).dropna().distinct()
    if measured_bytes(asked) > item_bytes:
        return _meet(corpus, asked, min_words, edits)
    return _scan(corpus, [(r[0], r[1]) for r in asked.collect()], min_words, edits)
