"""Evaluation texts leaking into training text: greedy string tiling on shared seeds.

The held-out passages are the stated, small query set: their k-word seeds go to every task
(in blocks of ``BLOCK_WORDS`` passage words, so what is sent is bounded whatever their
number).  Each document is read once, whole; nothing is shuffled.  Seeds are found with a
rolling Karp-Rabin hash and compared word by word.  Seeds on one diagonal join into runs;
the tiling takes the longest run first, marks its words on both sides, shortens what it
overlaps and goes on.  The tiles' length and coverage decide: a tile of ``RUN_WORDS`` is a
leak; a coverage below what a whole passage must leave is none; between the two an exact
word-edit distance follows.  Tiles may stand in any order: on request passages come too
of which as large a share is covered as edits would have to leave, marked as reordered.

Which seeds must be there is a bound, not a guess: with n words and at most e edits the
unbroken runs hold n - e words in e + 1 pieces, so at least n - e - (k - 1)(e + 1) seeds of
k words survive.  k is the largest up to 4 for which that is positive, for each passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelattice.llm.words import coded, slices, words

RUN_WORDS, EDIT_SHARE = 13, 5
BLOCK_WORDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "doc_id long, item_id long, longest int, coverage double, edits int, reordered boolean"


class Seeds:
    """Seeds of a block of passages."""

    def __init__(self, passages: list[tuple[int, list[str]]], run_words: int, edit_share: int):
        self.items = [(i, w) for i, w in passages if w]
        self.run_words, self.edit_share = run_words, edit_share
        self.vocabulary: dict[str, int] = {}
        for _, w in self.items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.codes = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in self.items]
        self.edits = [len(w) // edit_share for _, w in self.items]
        need, floor, by_k = [], [], {}
        for at, c in enumerate(self.codes):
            n, e = len(c), self.edits[at]
            k = next((k for k in (4, 3, 2, 1) if n - e - (k - 1) * (e + 1) >= 1), 1)
            need.append(max(1, min(n - e - (k - 1) * (e + 1), run_words - k + 1)))
            # words that tiles must cover if the whole passage is there: its runs of k words and more hold
            # n - e - (k - 1)(e + 1); a tile of t words, the longest left, takes at most 2 t of them and cuts four ends short
            least = min(k, 3)
            floor.append(max(least, (n - e - (k - 1) * (e + 1)) / (2 + 4 * (least - 1) / least)))
            by_k.setdefault(k, []).append(at)
        self.floor = floor
        self.need = np.array(need or [0])
        self.start = np.cumsum([0, *map(len, self.codes)])
        self.flat = np.concatenate([*self.codes, np.zeros(4, np.int64)])
        self.tables = []
        for k, ats in by_k.items():
            h = np.concatenate([_rolling(self.codes[a], k) for a in ats])
            pos = np.concatenate([self.start[a] + np.arange(max(0, len(self.codes[a]) - k + 1)) for a in ats])
            order = np.argsort(h, kind="stable")
            h, pos = h[order], pos[order]
            keys, first = np.unique(h, return_index=True)
            self.tables.append((k, keys, np.append(first, len(h)), pos))
        self.owner = np.repeat(np.arange(len(self.codes)), [len(c) for c in self.codes])


def _rolling(codes: np.ndarray, k: int) -> np.ndarray:
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, c = np.zeros(n, np.uint64), codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _BASE + c[j : j + n]
    return h ^ (h >> np.uint64(29))


def tile(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal matches (length, doc start, passage start), no word used twice.

    Longest first, ties by document place; a run that overlaps a tile is cut back to its
    free words and waits for its new length to come up.
    """
    import heapq

    heap = [(-n, d, p) for n, d, p in runs]
    heapq.heapify(heap)
    doc: set[int] = set()
    passage: set[int] = set()
    tiles = []
    while heap:
        n, d, p = heapq.heappop(heap)
        free, at = [], None
        for x in range(-n + 1):
            ok = x < -n and d + x not in doc and p + x not in passage
            if ok and at is None:
                at = x
            elif not ok and at is not None:
                free.append((at, x - at))
                at = None
        if free == [(0, -n)]:
            tiles.append((-n, d, p))
            doc.update(range(d, d - n))
            passage.update(range(p, p - n))
        else:
            for at, size in free:
                if size >= least:
                    heapq.heappush(heap, (-size, d + at, p + at))
    return tiles


def least_edits(passage: np.ndarray, text: np.ndarray) -> int:
    """Words changed, missing or added between the passage and the stretch of text most like it (bit-parallel)."""
    n = len(passage)
    where: dict[int, int] = {}
    for i, c in enumerate(passage.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for c in text.tolist():
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


def _pairs(codes: np.ndarray, ends: np.ndarray, seeds: Seeds):
    """(document, item, k, document places, passage places) of pairs with enough seeds."""
    for k, keys, first, pos in seeds.tables:
        h = _rolling(codes, k)
        if not len(h) or not len(keys):
            continue
        live = np.flatnonzero(codes[: len(h)] > 0)
        at = np.searchsorted(keys, h[live])
        at[at == len(keys)] = 0
        hit = keys[at] == h[live]
        d, at = live[hit], at[hit]
        reps = first[at + 1] - first[at]
        total = int(reps.sum())
        if not total:
            continue
        dd = np.repeat(d, reps)
        offset = np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps)
        pp = pos[np.repeat(first[at], reps) + offset]
        same = np.ones(total, bool)
        for j in range(k):
            same &= codes[np.minimum(dd + j, len(codes) - 1)] == seeds.flat[pp + j]
        doc = np.searchsorted(ends, dd, side="right")
        same &= dd + k <= ends[doc]
        dd, pp, doc = dd[same], pp[same], doc[same]
        item = seeds.owner[pp]
        pair = doc * len(seeds.codes) + item
        order = np.lexsort((dd, pp - dd, pair))
        dd, pp, pair = dd[order], pp[order], pair[order]
        uniq, begin, count = np.unique(pair, return_index=True, return_counts=True)
        for u, b, c in zip(uniq.tolist(), begin.tolist(), count.tolist(), strict=True):
            if c >= seeds.need[u % len(seeds.codes)]:
                yield u // len(seeds.codes), u % len(seeds.codes), k, dd[b : b + c], pp[b : b + c]


def compare(texts: list[str | None], seeds: Seeds, reordered: bool = False) -> Iterator[tuple]:
    """(text number, item id, longest tile, covered share, edits) of each text that carries an item; if asked for, also in another order, with a mark whether it is.

    ``edits`` is null where a long tile has decided before they were counted.
    """
    if not seeds.items:
        return
    codes, ends = coded(texts, seeds.vocabulary)
    for doc, item, k, dd, pp in _pairs(codes, ends, seeds):
        runs, n = [], len(seeds.codes[item])
        base = int(seeds.start[item])
        for _, g in groupby(range(len(dd)), lambda i: (pp[i] - dd[i], dd[i] - i)):
            g = list(g)
            runs.append((len(g) + k - 1, int(dd[g[0]]), int(pp[g[0]]) - base))
        tiles = tile(runs, min(k, 3))
        longest, covered = max(t[0] for t in tiles), sum(t[0] for t in tiles) / n
        # coverage decides: a run of its own is enough, a whole passage leaves at least ``floor`` words under tiles, another order all but its edits
        whole = sum(t[0] for t in tiles) >= seeds.floor[item]
        if longest < seeds.run_words and not whole:
            continue
        in_order, edits = longest >= seeds.run_words, None
        if not in_order or reordered:
            lo = max(0 if doc == 0 else int(ends[doc - 1]), int(dd.min()) - n - n // 5)
            hi = min(int(ends[doc]), int(dd.max()) + n + n // 5)
            edits = least_edits(seeds.codes[item], codes[lo:hi])
            in_order = in_order or edits <= seeds.edits[item]
        if in_order or (reordered and min(1.0, covered) * n >= n - seeds.edits[item] - 1e-9):
            yield doc, seeds.items[item][0], longest, min(1.0, covered), edits, *([not in_order] if reordered else [])


def leaks(documents: DataFrame, items: DataFrame, run_words: int = RUN_WORDS, edit_share: int = EDIT_SHARE, reordered: bool = False) -> DataFrame:
    """Documents that carry a held-out passage, with the items they carry.

    ``documents`` (doc_id, text), ``items`` (item_id, passage) ->
    ``(doc_id, item_id, longest, coverage, edits, reordered)``, a row for each document and item where
    ``run_words`` words of the passage stand in a row, or the whole passage stands with at
    most one word in ``edit_share`` changed, missing or added.  ``coverage`` is the share
    of the passage under tiles, in whatever order; with ``reordered``, rows that only
    stand for their coverage come too, marked so: all but one word in ``edit_share`` is
    there, in shorter pieces.  ``edits`` is null where a tile of ``run_words`` decided, unless
    ``reordered`` rows are asked for.

    A null or wordless text carries nothing; a null or wordless passage is carried by
    nothing; repeated documents give repeated rows; repeated items count once for each
    distinct passage; further columns are not read; empty inputs give an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, block, size = None, [], 0
    held = items.select(F.col("item_id").cast("long"), F.col("passage").cast("string")).where("passage IS NOT NULL").distinct().orderBy("item_id", "passage")

    def scan(block):
        sent = spark.sparkContext.broadcast(Seeds(block, run_words, edit_share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for whole in batches for part in slices(whole)):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], *rest, *([] if reordered else [False])) for d, *rest in compare(b.column("text").to_pylist(), sent.value, reordered)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.bool_()), strict=True)], ["doc_id", "item_id", "longest", "coverage", "edits", "reordered"])

        return docs.mapInArrow(run, FIELDS)

    for r in held.toLocalIterator():
        w = words(r.passage)
        if block and size + len(w) > BLOCK_WORDS:
            one = scan(block)
            found, block, size = one if found is None else found.unionByName(one), [], 0
        block.append((r.item_id, w))
        size += len(w)
    one = scan(block)
    return one if found is None else found.unionByName(one)
