"""Filling fixed-capacity containers with texts: large-item matching on exact size counts.

A token count is a whole number up to the capacity, so the whole packing problem is the
table of how many items have each size, at most ``capacity`` rows whatever the corpus.  The
plan is worked out on those counts: items above a third of the capacity are matched (at most
two fit a container) largest first with the largest partner that still fits; smaller items,
largest first, go where they leave least room.  The result is the one that item-by-item
packing would give.  Items then find their place by their rank among items of equal size,
worked out in hashed blocks, so no size is ever sorted in one task.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codelattice.plans.materialize import Workspace

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one size that are ranked in one task, about.
RANK_BLOCK = 500_000
_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): length of each whole text in tokens; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Containers as (how many alike, sizes within), from how many items have each size."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    large = sorted(s for s in left if 3 * s > capacity)
    alike: dict[int, list[tuple[int, list[int]]]] = {}
    gaps: list[int] = []

    def put(gap: int, n: int, sizes: list[int]) -> None:
        if gap not in alike:
            alike[gap] = []
            insort(gaps, gap)
        alike[gap].append((n, sizes))

    live = list(large)  # ascending, sizes with items left
    while live:
        a = live[-1]
        partner = None
        at = bisect_left(live, capacity - a + 1) - 1
        if at >= 0:
            partner = live[at] if live[at] != a or left[a] > 1 else (live[at - 1] if at > 0 else None)
        if partner is None:
            n, sizes = left[a], [a]
        elif partner == a:
            n, sizes = left[a] // 2, [a, a]
        else:
            n, sizes = min(left[a], left[partner]), [a, partner]
        put(capacity - sum(sizes), n, sizes)
        for s in sizes:
            left[s] -= n
        for s in set(sizes):
            if not left[s]:
                live.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        m = left[s]
        while m:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                per = capacity // s
                full, rest = divmod(m, per)
                if full:
                    put(capacity - per * s, full, [s] * per)
                if rest:
                    put(capacity - rest * s, 1, [s] * rest)
                break
            g = gaps[at]
            n, sizes = alike[g].pop()
            if not alike[g]:
                del alike[g]
                gaps.pop(at)
            per = g // s
            full = min(n, m // per)
            rest = m - full * per if full < n else 0
            if full:
                put(g - per * s, full, sizes + [s] * per)
            m -= full * per
            if full < n:  # the items run out within this kind
                if rest:
                    put(g - rest * s, 1, sizes + [s] * rest)
                    m -= rest
                if n - full - bool(rest):
                    put(g, n - full - bool(rest), sizes)
    return [x for g in sorted(alike) for x in alike[g]]


class Places:
    """Which container the n-th item of a size lies in."""

    def __init__(self, containers: list[tuple[int, list[int]]]):
        rows, base = [], 0
        seen: dict[int, int] = {}
        for n, sizes in containers:
            for s in sizes:
                rows.append((s, seen.get(s, 0), base))
                seen[s] = seen.get(s, 0) + n
            base += n
        rows.sort()
        self.size, self.rank, self.base = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.step = np.int64(max([1, *seen.values()]) + 1)

    def of(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.size * self.step + self.rank, size * self.step + rank, side="right") - 1
        return self.base[at] + rank - self.rank[at]


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Lay every text into a container of ``capacity`` tokens.

    Returns ``(doc_id, piece, first_token, tokens, container_id)``.  A text is divided only
    if it alone is longer than the capacity, into full pieces and one rest.  A null or empty
    text takes no room: piece 0, 0 tokens, container null.  A repeated doc_id counts once
    (its longest text); equal sizes take their places in an order given by hashed ids, then
    doc_id; further columns are not read; an empty input gives an empty result.
    """
    work = Workspace(documents.sparkSession, "packing")
    sizes = work.write(token_counts(documents, tokenizer), "tokens")
    sizes = work.write(sizes.groupBy("doc_id").agg(F.max("tokens").alias("tokens")), "sizes")
    cap = F.lit(capacity)
    pieces = sizes.where("tokens > 0").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / cap)), lambda i: F.least(cap.cast("long"), F.col("tokens") - i * cap))).alias("piece", "size"))
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = documents.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    most = max(counts.values(), default=0)
    blocks = max(16, most // RANK_BLOCK)
    items = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n")).select("size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("size", "block").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("within", within).join(offsets, ["size", "block"])
    ranked = ranked.select("doc_id", "piece", F.col("size").alias("tokens"), (F.col("within") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            box = sent.value.of(b.column("tokens").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("tokens"), pa.array(box, pa.int64())], ["doc_id", "piece", "tokens", "container_id"])

    placed = ranked.mapInArrow(place, "doc_id long, piece int, tokens long, container_id long")
    out = placed.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "tokens", "container_id")
    none = sizes.where("tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "tokens", F.lit(None).cast("long").alias("container_id"))
    return out.unionByName(none)


def fill_report(placed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row on a packing of ``documents``: what must be so, and how much room is left.

    ``documents`` and ``lost_documents`` (without a place), ``containers`` and
    ``over_capacity``, ``needlessly_divided`` (texts in several pieces that would fit one
    container), ``gapped`` (texts whose pieces don't follow each other), ``tokens``,
    ``least_containers`` (the tokens' share of the capacity, rounded up) and ``fill``.
    """
    boxes = placed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("tokens").alias("t"))
    room = boxes.agg(F.count(F.lit(1)).alias("containers"), F.count_if(F.col("t") > capacity).alias("over_capacity"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    texts = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("piece").alias("last"))
    asked = documents.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("asked", F.lit(1))
    seen = texts.join(asked, "doc_id", "full").agg(
        F.count("asked").alias("documents"), F.count_if(F.col("asked").isNotNull() & F.col("k").isNull()).alias("lost_documents"),
        F.count_if((F.col("k") > 1) & (F.col("t") <= capacity)).alias("needlessly_divided"), F.count_if((F.col("end") != F.col("t")) | (F.col("last") != F.col("k") - 1)).alias("gapped"),
    )
    r = room.first()
    fill = round(r["tokens"] / (r["containers"] * capacity), 6) if r["containers"] else None
    more = {"containers": r["containers"], "over_capacity": r["over_capacity"], "tokens": r["tokens"], "least_containers": -(-r["tokens"] // capacity)}
    return seen.select("*", *(F.lit(v).cast("long").alias(c) for c, v in more.items()), F.lit(fill).cast("double").alias("fill"))
