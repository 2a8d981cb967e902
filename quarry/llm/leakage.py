"""p7: passages of test items inside corpus documents.

A passage is any run of `words` consecutive normalised words of an item. With an error budget of e word edits,
a passage is cut into e + 1 pieces, of which at least one must occur exactly: all items are cut at every multiple
of the piece length, and the length is the longest with which each passage holds e + 1 whole pieces. Documents
are scanned once for exact pieces; around each hit Myers' bit-parallel recurrence, run over all hits at once in
64-bit words, gives the edit distance of the passages that hold the piece.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.runtime import spread

HIDDEN = re.compile("[­​‌‍⁠﻿]")
HYPHENED = re.compile(r"(?<=[^\W\d_])-\r?\n(?=[^\W\d_])")
RUN = re.compile(r"[^\W_]+")
FILTER_BITS = 20


def normal_words(text: str) -> list[str]:
    """NFKC, zero-width characters and soft hyphens removed, words hyphenated at a line end joined, lower case."""
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "-\n" in text or "-\r" in text:
        text = HYPHENED.sub("", text)
    return RUN.findall(text.lower())


def piece_length(words: int, budget: int) -> int:
    """A run of n words holds at least (n + 1) // q - 1 whole pieces of a grid of width q."""
    return max(1, (words + 1) // (budget + 2))


def myers(patterns: np.ndarray, texts: np.ndarray, global_start: bool = False) -> np.ndarray:
    """Least edit distance of each pattern (row of up to 64 symbols) to any part of the text in the same row."""
    rows, m = patterns.shape
    one, high = np.uint64(1), np.uint64(m - 1)
    vp = np.full(rows, ~np.uint64(0))
    vn = np.zeros(rows, np.uint64)
    score = np.full(rows, m)
    least = score.copy()
    for j in range(texts.shape[1]):
        eq = np.zeros(rows, np.uint64)
        for k in range(m):
            eq |= (patterns[:, k] == texts[:, j]).astype(np.uint64) << np.uint64(k)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp)
        hn = vp & xh
        score += ((hp >> high) & one).astype(np.int64) - ((hn >> high) & one).astype(np.int64)
        hp = (hp << one) | (one if global_start else np.uint64(0))
        hn = hn << one
        vp = hn | ~(xv | hp)
        vn = hp & xv
        np.minimum(least, score, out=least)
    return least


class PassageIndex:
    """Pieces of a block of items; its size is that of the items, whatever the corpus."""

    def __init__(self, items: list[tuple[int, str]], words: int, budget: int):
        self.words, self.budget, self.q = words, budget, piece_length(words, budget)
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        flat, owner, pad = [], [], words + budget
        self.where = []
        for n, (_, text) in enumerate(items):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in normal_words(text)]
            self.where.append((len(flat) + pad, len(own)))
            flat += [-1] * pad + own
            owner += [n] * (pad + len(own))
        self.flat = np.array(flat + [-1] * pad, np.int64)
        self.owner = np.array(owner + [-1] * pad, np.int64)
        starts = np.array([a + k for a, n in self.where if n >= words for k in range(0, n - self.q + 1, self.q)], np.int64)
        keys = self._keys(self.flat)[starts] if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.piece_key, first, self.piece_n = np.unique(keys[order], return_index=True, return_counts=True)
        self.piece_first, self.piece_at = first, starts[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.piece_key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = ids.astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(self.q):
            key = (key ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key * np.uint64(0xD1342543DE82EF95)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every exact occurrence of a piece: its place in ids and in the items."""
        key = self._keys(ids)
        at = np.flatnonzero(self.maybe[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]) if len(key) else np.zeros(0, np.int64)
        if not len(at) or not len(self.piece_key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.piece_key, key[at]), len(self.piece_key) - 1)
        good = self.piece_key[slot] == key[at]
        at, slot = at[good], slot[good]
        n = self.piece_n[slot]
        place = np.repeat(at, n)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.piece_at[np.repeat(self.piece_first[slot], n) + turn]
        same = np.ones(len(place), bool)
        for k in range(self.q):
            same &= ids[place + k] == self.flat[item + k]
        return place[same], item[same]

    def match(self, texts: list[str | None], block: int = 400_000):
        """(text number, item number, least distance, longest exact run) of each pair within the budget."""
        get = self.vocabulary.get
        pad = self.words + self.budget
        flat, size = [], []
        for t in texts:
            own = [get(w, 0) for w in normal_words(t)] if t else []
            flat += [-2] * pad
            flat += own
            size.append(len(own) + pad)
        ids = np.array(flat + [-2] * pad, np.int64)
        owner = np.append(np.repeat(np.arange(len(texts)), size), np.full(pad, -1))
        place, item = self.hits(ids)
        found = []
        for a in range(0, len(place), block):
            found.append(self._verify(ids, owner, place[a : a + block], item[a : a + block]))
        if not found:
            return [np.zeros(0, np.int64)] * 4
        doc, it, dist, run = map(np.concatenate, zip(*found))
        order = np.lexsort((-run, dist, it, doc))
        doc, it, dist, run = doc[order], it[order], dist[order], run[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (it[1:] != it[:-1])]) if len(doc) else np.zeros(0, np.int64)
        longest = np.maximum.reduceat(run, first) if len(first) else run
        return doc[first], it[first], dist[first], longest

    def _verify(self, ids, owner, place, item):
        w, e, q = self.words, self.budget, self.q
        reach = w - q
        left = np.zeros(len(place), np.int64)
        alive = np.ones(len(place), bool)
        for k in range(1, reach + 1):
            alive &= ids[place - k] == self.flat[item - k]
            left += alive
        right = np.zeros(len(place), np.int64)
        alive[:] = True
        for k in range(reach + 1):
            alive &= ids[np.minimum(place + q + k, len(ids) - 1)] == self.flat[np.minimum(item + q + k, len(self.flat) - 1)]
            right += alive
        run = left + q + right
        # An exact run is its own proof; the others go through all passages that hold the piece.
        doc, it = owner[place], self.owner[item]
        exact = run >= w
        distance = np.where(exact, 0, e + 1)
        if e:
            some = np.flatnonzero(~exact)
            if len(some):
                distance[some] = self._approximate(ids, place[some], item[some], left[some], right[some])
        ok = distance <= e
        return doc[ok], it[ok], distance[ok], run[ok]

    def _approximate(self, ids, place, item, left, right):
        w, e, q = self.words, self.budget, self.q
        best = np.full(len(place), e + 1)
        for shift in range(w - q + 1):
            cols = np.arange(w) - shift
            pattern = self.flat[np.clip(item[:, None] + cols, 0, len(self.flat) - 1)]
            at = (pattern > 0).all(1) & (best > 1)
            if e == 1:  # the only edit lies on one side of the piece, so the other side is exact
                at &= (left >= shift) | (right >= w - q - shift)
            at = np.flatnonzero(at)
            if not len(at):
                continue
            span = np.arange(w + 2 * e) - shift - e
            text = ids[np.clip(place[at][:, None] + span, 0, len(ids) - 1)]
            best[at] = np.minimum(best[at], myers(pattern[at], text))
        return best


def leaked_passages(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, words: int = 12, budget: int = 1, block_chars: int = 8_000_000) -> DataFrame:
    """(id_col, item_col, distance, longest_run): each document with each item of which it holds a passage.

    distance: least word edits of any passage; longest_run: the most consecutive words found exactly, counted
    up to a little over `words`. Items are broadcast in blocks of at most block_chars characters, each block one
    pass over the documents; there is no shuffle and no pair of documents. Items shorter than `words` have no
    passage; null and empty texts match nothing; an item given twice is reported once, a document row given
    twice twice.
    """
    sc = docs.sparkSession.sparkContext
    rows = spread(docs.select(id_col, text_col))
    kind, item_kind = rows.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance int, longest_run int"
    out = None
    for block in item_blocks(items.select(item_col, item_text), block_chars):
        shared = sc.broadcast(PassageIndex(block, words, budget))

        def run(batches, shared=shared):
            index = shared.value
            names = pa.array(index.ids)
            for b in batches:
                doc, it, dist, longest = index.match(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), names.take(pa.array(it)), pa.array(dist, pa.int32()), pa.array(longest, pa.int32())],
                    [id_col, item_col, "distance", "longest_run"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list]:
    """The different test items in blocks of bounded size; the driver holds one block and one partition at a time."""
    block, size = [], 0
    for r in items.where(F.col(items.columns[1]).isNotNull()).distinct().toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block
