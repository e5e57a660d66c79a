"""Most similar vectors for every vector: randomly rotated one-bit codes with error bounds.

Equal vectors are one class, searched once.  Each model's vectors are laid into lists round
centroids fitted on a bounded sample; a vector looks into its ``probes`` nearest lists.
Beyond ``FLAT`` lists the centroids have two levels: cells fitted on the driver, the lists
of a cell in a task of their own; a vector compares itself to the lists of its nearest cells
only.  Centroids are held to ``LAYOUT_BYTES``; where lists would grow for that, the task that
searches a long list parts it again, so what a vector is compared with does not grow.
Lists that lie near each other share a shard, so a vector travels to the few shards that
hold its lists, not to every list.  Within a list a member is one bit for each dimension of
its rotated residual and two numbers; a query is four bit planes.  Popcounts give the
estimated inner product and the code's own length its error bound; members whose upper
bound reaches the k-th best lower bound, or the k-th exact cosine so far, are compared
exactly, in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codelattice.plans.materialize import Workspace
from codelattice.plans.skew import split_join

K, PROBES, LIST_ROWS, SAMPLE_PER_LIST = 5, 8, 256, 32
#: Lists up to which centroids have one level; cells of the upper level otherwise, at most; lists of one cell, at most.
FLAT, CELLS, CELL_LISTS = 1024, 1024, 1024
#: Cells whose lists a vector compares itself with.
NEAR_CELLS = 12
#: Bytes of all models' centroids together.
LAYOUT_BYTES = 64_000_000
#: Members of a shard, and queries that visit it in one task, about: rows, and bytes of their vectors.
SHARD_ROWS, SHARD_QUERIES = 30_000, 200_000
SHARD_BYTES, QUERY_BYTES = 24_000_000, 64_000_000
#: Queries of a task at least, where fewer would keep more tasks busy.
LEAST_QUERIES = 32_000
#: A list is not worth a visit if its centroid's cosine is that much below the nearest one's.
MARGIN = 0.2
#: Members that the lists visited hold together before that margin cuts.
ENOUGH = 48
#: Standard deviations of the estimate's error that the bounds allow for.
EPSILON = 2.2
_PLANES = 4


def _matrix(column: pa.Array, dims: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row numbers, float32 matrix, dim) of the usable vectors of a batch, for each dim."""
    want = dims.to_numpy(zero_copy_only=False).astype(np.float64)
    null = np.asarray(column.is_null())
    lengths = np.asarray(column.value_lengths().fill_null(0))
    starts = np.asarray(column.offsets)[:-1].astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32)
    want = np.where(np.isnan(want), lengths, want).astype(np.int64)
    for dim in np.unique(want):
        at = np.flatnonzero((want == dim) & (dim > 0) & ~null & (lengths >= dim))
        if len(at):
            x = values[starts[at][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            if good.any():
                yield at[good], x[good], int(dim)


def _usable(vectors: DataFrame, wide: bool) -> DataFrame:
    """Usable rows as (vec_id, model, key[, vec]): key is a 128-bit digest of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x, dim in _matrix(b.column("embedding"), b.column("dim")):
                x = x + np.float32(0)  # -0 is 0
                rows = [v.tobytes() for v in x]
                idx = pa.array(at)
                model = pa.array([f"{m}|{dim}" for m in b.column("model").take(idx).to_pylist()])
                out = [b.column("vec_id").take(idx), model, pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(rows, pa.binary())] if wide else out, ["vec_id", "model", "key", "vec"][: 4 if wide else 3])

    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("model").cast("string"), F.lit("")).alias("model"), F.col("dim").cast("int").alias("dim"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, model string, key binary" + ", vec binary" * wide)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _flat(x: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors in single precision, without a double copy of the whole; their lengths go to ``size``."""
    out = np.empty(x.shape, np.float32)
    for i in range(0, len(x), 8192):
        part = x[i : i + 8192].astype(np.float64)
        n = np.sqrt((part * part).sum(axis=1))
        out[i : i + 8192] = part / n[:, None]
        if size is not None:
            size[i : i + 8192] = n
    return out


def _centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32, copy=False)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=n) == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(1e-12, np.linalg.norm(total, axis=1))[:, None]
    return c


def _sizes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How many of a sample are nearest to each centroid."""
    return np.bincount(np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)]), minlength=len(c)).astype(float)


def _top(s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The p greatest of each row, greatest first, and their places."""
    p = min(p, s.shape[1])
    top = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < s.shape[1] else np.tile(np.arange(p), (len(s), 1))
    order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    return np.take_along_axis(s, top, 1), top


def _worth(near: np.ndarray, top: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which lists are worth a visit: near enough to the nearest one, or before there are ``ENOUGH`` members to choose from."""
    before = np.cumsum(size[top], axis=1) - size[top]
    return (near >= near[:, :1] - MARGIN) | (before < ENOUGH)


class Layout:
    """Centroids of one model, the shards its lists lie in, and the rotation of its codes."""

    def __init__(self, dim: int, centroids: np.ndarray, size: np.ndarray | None = None, cells: np.ndarray | None = None, starts: np.ndarray | None = None):
        """``centroids`` of the lists and their ``size`` as the sample has it; with ``cells`` those of cell i are ``starts[i]`` to ``starts[i + 1]``."""
        self.dim, self.c, self.cells, self.starts = dim, centroids, cells, starts
        self.size = np.full(len(centroids), 1e9) if size is None else size
        rng = np.random.default_rng(dim)
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        self.rotation = (q * np.sign(np.diag(r))).astype(np.float32)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The lists that each vector visits, nearest first, -1 for none."""
        p = min(probes, len(self.c))
        out = np.empty((len(x), p), np.int32)
        for i in range(0, len(x), 2048):
            part = x[i : i + 2048].astype(np.float32, copy=False)
            near, top = _top(part @ self.c.T, p) if self.cells is None else self._by_cells(part, p)
            out[i : i + 2048] = np.where(_worth(near, top, self.size), top, -1)
        return out

    def _by_cells(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        near, top = np.full((len(x), p), -9, np.float32), np.full((len(x), p), -1, np.int64)
        _, cells = _top(x @ self.cells.T, NEAR_CELLS)
        for cell in np.unique(cells):
            a, b = self.starts[cell], self.starts[cell + 1]
            row = np.flatnonzero((cells == cell).any(axis=1))
            if b > a:
                found, at = _top(x[row] @ self.c[a:b].T, p)
                both, ids = np.concatenate([near[row], found], axis=1), np.concatenate([top[row], at + a], axis=1)
                near[row], order = _top(both, p)
                top[row] = np.take_along_axis(ids, order, 1)
        return near, top

    def share_out(self, members: np.ndarray, visits: np.ndarray, first: int, rows: int, queries: int) -> int:
        """Number the shards from ``first``: near lists together, long ones over several blocks."""
        self.blocks, self.shard = {}, np.zeros(len(self.c), np.int64)
        self.parts: dict[int, tuple[int, int]] = {}  # shard -> (first key, keys): its queries spread over the keys
        key = [first]

        def close(lists: np.ndarray, visiting: int) -> int:
            n = max(1, math.ceil(visiting / queries))
            shard = key[0]
            self.parts[shard] = (shard, n)
            key[0] += n
            return shard

        def split(lists: np.ndarray) -> None:
            total = members[lists].sum()
            if len(lists) == 1 and total > 2 * rows:
                n = math.ceil(total / rows)
                self.blocks[int(lists[0])] = [close(lists, int(visits[lists[0]])) for _ in range(n)]
                self.shard[lists] = self.blocks[int(lists[0])][0]
            elif total <= rows or len(lists) == 1:
                self.shard[lists] = close(lists, int(visits[lists].max() + visits[lists].sum() // 2))
            else:
                x = self.c[lists] - self.c[lists].mean(axis=0)
                axis = np.linalg.svd(x, full_matrices=False)[2][0]
                order = lists[np.argsort(x @ axis, kind="stable")]
                at = int(np.searchsorted(members[order].cumsum(), total / 2)) + 1
                at = min(max(1, at), len(order) - 1)
                split(order[:at])
                split(order[at:])

        if len(self.c):
            split(np.arange(len(self.c)))
        return key[0]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Residuals -> packed bits (n, words), their lengths, and <code, residual> of unit length."""
        size = np.linalg.norm(residual, axis=1)
        r = (residual.astype(np.float32) @ self.rotation) / np.maximum(size, 1e-12)[:, None].astype(np.float32)
        return _pack(r > 0), size, np.abs(r).sum(axis=1) / math.sqrt(self.dim)

    def planes(self, residual: np.ndarray):
        """Queries' residuals -> four bit planes, least value, step, sum of the whole numbers, length."""
        size = np.linalg.norm(residual, axis=1)
        r = (residual.astype(np.float32) @ self.rotation) / np.maximum(size, 1e-12)[:, None].astype(np.float32)
        low = r.min(axis=1)
        step = np.maximum((r.max(axis=1) - low) / (2**_PLANES - 1), 1e-12)
        u = np.rint((r - low[:, None]) / step[:, None]).astype(np.uint8)
        return [_pack((u >> j) & 1 > 0) for j in range(_PLANES)], low, step, u.sum(axis=1, dtype=np.int64), size


def _pack(bits: np.ndarray) -> np.ndarray:
    words = -(-bits.shape[1] // 64)
    padded = np.zeros((len(bits), words * 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def _codes(layout: Layout, residual: np.ndarray):
    """What the bounds need of the members of a list: bits, and factors of the four terms."""
    bits, size, fit = layout.encode(residual)
    fit = np.maximum(fit, 1e-6)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    e = EPSILON * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / math.sqrt(max(1, layout.dim - 1)) + 1e-4
    centre = np.stack([np.ones(len(size)), -size * size / 2, size * ones / fit, size / fit]).astype(np.float32)
    spread = np.stack([size * e, size / fit]).astype(np.float32)
    return bits, (size / fit).astype(np.float32), centre, spread


def _asks(layout: Layout, residual: np.ndarray):
    """The same of the queries."""
    planes, low, step, total, size = layout.planes(residual)
    d = math.sqrt(layout.dim)
    centre = np.stack([1 - size * size / 2, np.ones(len(size)), size * 2 * low / d, -size * (step * total + layout.dim * low) / d], axis=1).astype(np.float32)
    # the second term: rounding the query to 4 bits
    spread = np.stack([size, size * step * EPSILON * 0.29], axis=1).astype(np.float32)
    return planes, (size * 2 * step / d).astype(np.float32), centre, spread


def _bounds(codes, asks) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of unit vectors from packed bits, and how far off they may be: (queries, members).

    |q - o|^2 = |q - c|^2 + |o - c|^2 - 2 |q - c| |o - c| <q', o'>, and the cosine is
    1 - |q - o|^2 / 2; every term is a product of a query's and a member's factor, except
    the popcount of their bits.
    """
    bits, factor, mc, ms = codes
    planes, qfactor, qc, qs = asks
    dot = None
    for p in reversed(planes):
        if dot is not None:
            np.left_shift(dot, 1, out=dot)
        for w in range(bits.shape[1]):
            n = np.bitwise_count(p[:, w][:, None] & bits[:, w][None, :])
            if dot is None:
                dot = n.astype(np.uint16)
            else:
                np.add(dot, n, out=dot)
    centre = dot.astype(np.float32)
    centre *= factor[None, :]
    centre *= qfactor[:, None]
    centre += qc @ mc
    return centre, qs @ ms


def _merge(best: np.ndarray, ids: np.ndarray, at: np.ndarray, qi: np.ndarray, cos: np.ndarray, nid: np.ndarray) -> None:
    """Take (query, cosine, id) rows into the best k of the queries ``at``; ties by smaller id."""
    k = best.shape[1]
    order = np.lexsort((nid, -cos, qi))
    qi, cos, nid = qi[order], cos[order], nid[order]
    touched, first = np.unique(qi, return_index=True)
    slot = np.repeat(np.arange(len(touched)), np.diff(np.append(first, len(qi))))
    rank = np.arange(len(qi)) - first[slot]
    keep = rank < k
    new_c, new_i = np.full((len(touched), k), -np.inf), np.full((len(touched), k), np.iinfo(np.int64).max)
    new_c[slot[keep], rank[keep]], new_i[slot[keep], rank[keep]] = cos[keep], nid[keep]
    to = at[touched]
    both_c, both_i = np.concatenate([best[to], new_c], axis=1), np.concatenate([ids[to], new_i], axis=1)
    order = np.lexsort((both_i, -both_c), axis=1)[:, :k]
    best[to], ids[to] = np.take_along_axis(both_c, order, 1), np.take_along_axis(both_i, order, 1)


def _parts(layout: Layout, flat: np.ndarray, members: np.ndarray, visiting: np.ndarray, queries: np.ndarray, first: np.ndarray, ell: int, probes: int, list_rows: int):
    """A list as (centroid, members, queries for which it comes first, others): parted anew where it is long.

    ``visiting`` are places in ``queries``, ``first`` says for which of them the list is the nearest.
    """
    n = len(members) // list_rows
    if n < 8:
        yield layout.c[ell].astype(np.float32), members, visiting[first], visiting[~first]
        return
    rng = np.random.default_rng(5)
    sample = members if len(members) <= SAMPLE_PER_LIST * n else np.sort(rng.choice(members, SAMPLE_PER_LIST * n, replace=False))
    c = _centroids(flat[sample], n)
    own = np.concatenate([(flat[members[i : i + 4096]] @ c.T).argmax(axis=1) for i in range(0, len(members), 4096)])
    to = np.empty((len(visiting), min(probes, n)), np.int64)
    size = np.bincount(own, minlength=n)
    for i in range(0, len(visiting), 2048):
        near, top = _top(flat[queries[visiting[i : i + 2048]]] @ c.T, probes)
        to[i : i + 2048] = np.where(_worth(near, top, size), top, -1)
    for j in range(n):
        best = (to[:, 0] == j) & first
        also = (to == j).any(axis=1) & ~best
        yield c[j], members[own == j], visiting[best], visiting[also]


def search_shard(layout: Layout, k: int, rep: np.ndarray, vec: np.ndarray, lists: np.ndarray, role: np.ndarray, probes: int = PROBES, list_rows: int = LIST_ROWS, exact: bool = False):
    """Best k of the shard's members for each query that visits it: (query ids, ids, cosines), -1 where there are fewer.

    ``role`` & 1: member (of the list ``lists[:, 0]``); & 2: query (of all its lists).
    A query's nearest list in the shard comes first; what it finds there is the bar for the others.
    ``exact`` compares all of them in double precision.
    """
    length = np.empty(len(vec))
    flat = _flat(vec, length)
    member, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    home = lists[member, 0]
    own = np.unique(home)
    best = np.full((len(query), k), -np.inf)
    ids = np.full((len(query), k), np.iinfo(np.int64).max)
    here = np.isin(lists[query], own)  # -1 is no list of a member
    nearest = np.where(here.any(axis=1), lists[query][np.arange(len(query)), here.argmax(axis=1)], -1)
    parts = []
    for ell in own.tolist():
        visiting = np.flatnonzero(((lists[query] == ell) & here).any(axis=1))
        first = nearest[visiting] == ell
        if exact:
            parts.append((layout.c[ell].astype(np.float32), member[home == ell], visiting, visiting[:0]))
        else:
            parts += _parts(layout, flat, member[home == ell], visiting, query, first, ell, probes, list_rows)
    for turn in (0, 1):
        for c, members, *turns in parts:
            q_at = turns[turn]
            if not len(q_at):
                continue
            for m0 in range(0, len(members), 4096):
                mm = members[m0 : m0 + 4096]
                codes = _codes(layout, flat[mm] - c)
                rows = max(1, 100_000 // len(mm))
                for i in range(0, len(q_at), rows):
                    at = q_at[i : i + rows]
                    qq = query[at]
                    need = best[at, k - 1]
                    if exact:
                        qi, mi = (x.reshape(-1) for x in np.mgrid[0 : len(qq), 0 : len(mm)])
                    else:
                        centre, spread = _bounds(codes, _asks(layout, flat[qq] - c))
                        if turn == 0 and len(mm) > k + 1:
                            # the k + 1 that look best, compared exactly, set the bar (one may be the query itself)
                            top = np.argpartition(-centre, k, axis=1)[:, : k + 1]
                            close = np.einsum("ij,ikj->ik", flat[qq], flat[mm[top]])
                            close[rep[mm[top]] == rep[qq][:, None]] = -9
                            need = np.maximum(need, -np.partition(-close, k - 1, axis=1)[:, k - 1] - 1e-6)
                        centre += spread
                        qi, mi = np.nonzero(centre >= need[:, None].astype(np.float32))
                    step = max(1, 4_000_000 // layout.dim)
                    for s in range(0, len(qi), step):
                        q, m = qi[s : s + step], mi[s : s + step]
                        near = np.einsum("ij,ij->i", flat[qq[q]], flat[mm[m]])
                        keep = (near >= need[q] - 1e-6) & (rep[mm[m]] != rep[qq[q]])
                        q, m = q[keep], m[keep]
                        if len(q):
                            a, b = qq[q], mm[m]
                            _merge(best, ids, at, q, np.einsum("ij,ij->i", vec[a].astype(np.float64) / length[a, None], vec[b].astype(np.float64) / length[b, None]), rep[b])
    ids[~np.isfinite(best)] = -1
    return rep[query], ids, best


def _blob(vec: pa.Array, dim: int) -> np.ndarray:
    joined = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    return np.frombuffer(b"".join(joined.to_pylist()), np.float32).reshape(-1, dim)


def _fitted(vectors: DataFrame, counts: dict[str, int], wanted: dict[str, int]) -> dict[str, Layout]:
    """Centroids of each model: one level on the driver, or cells there and each cell's lists in a task."""
    spark = vectors.sparkSession

    def sample(rows: dict[str, int]) -> DataFrame:
        share = F.lit(0.0)
        for m, n in counts.items():
            share = F.when(F.col("model") == m, F.lit(min(1.0, SAMPLE_PER_LIST * max(20, rows[m]) / n))).otherwise(share)
        return _usable(vectors, wide=True).where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share * 1_000_000).select("model", "vec")

    upper = {m: n if n <= FLAT else min(CELLS, math.isqrt(n) + 1) for m, n in wanted.items()}
    taken = sample(upper).toArrow()
    tops: dict[str, np.ndarray] = {}
    layouts: dict[str, Layout] = {}
    for m in sorted(counts):
        dim = int(m.rsplit("|", 1)[1])
        own = taken.filter(pa.compute.equal(taken.column("model"), m)) if taken.num_rows else taken
        x = np.unique(_blob(own.column("vec"), dim), axis=0) if own.num_rows else np.ones((1, dim), np.float32)
        x = _flat(x)
        tops[m] = _centroids(x, min(upper[m], len(x)))
        layouts[m] = Layout(dim, tops[m], _sizes(x, tops[m]) * (counts[m] / len(x)))
    deep = [m for m in tops if wanted[m] > FLAT]
    if not deep:
        return layouts
    sent = spark.sparkContext.broadcast({m: layouts[m] for m in deep})

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = np.array(b.column("model").to_pylist(), object)
            for m in np.unique(models) if len(models) else ():
                t = b.take(pa.array(np.flatnonzero(models == m)))
                near = sent.value[m].nearest(_flat(_blob(t.column("vec"), sent.value[m].dim)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([t.column("model"), pa.array(near, pa.int32()), t.column("vec")], ["model", "cell", "vec"])

    def fit(t: pa.Table) -> pa.Table:
        m, cell = t.column("model")[0].as_py(), t.column("cell")[0].as_py()
        x = np.unique(_blob(t.column("vec"), sent.value[m].dim), axis=0)
        x = _flat(x)
        c = _centroids(x, max(1, min(CELL_LISTS, len(x) // SAMPLE_PER_LIST)))
        size = _sizes(x, c) * (counts[m] / (SAMPLE_PER_LIST * wanted[m]))
        return pa.table({"model": [m], "cell": pa.array([cell], pa.int32()), "lists": pa.array([c.tobytes()], pa.binary()), "size": pa.array([size.tolist()], pa.list_(pa.float64()))})

    rows = sample(wanted).where(F.col("model").isin(deep)).mapInArrow(to_cell, "model string, cell int, vec binary")
    nth = F.row_number().over(Window.partitionBy("model", "cell").orderBy(F.xxhash64("vec")))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_PER_LIST * CELL_LISTS).drop("nth")
    found = rows.groupBy("model", "cell").applyInArrow(fit, "model string, cell int, lists binary, size array<double>").toArrow().to_pylist()
    for m in deep:
        dim, parts = layouts[m].dim, {r["cell"]: np.frombuffer(r["lists"], np.float32).reshape(-1, layouts[m].dim) for r in found if r["model"] == m}
        each = [parts.get(i, np.empty((0, dim), np.float32)) for i in range(len(tops[m]))]
        size = {r["cell"]: r["size"] for r in found if r["model"] == m}
        layouts[m] = Layout(dim, np.concatenate(each), np.array([n for i in range(len(each)) for n in size.get(i, ())]), tops[m], np.append(0, np.cumsum([len(x) for x in each])))
    return layouts


def most_similar(vectors: DataFrame, k: int = K, probes: int = PROBES, list_rows: int = LIST_ROWS, shard_rows: int = SHARD_ROWS, shard_queries: int = SHARD_QUERIES, exact: bool = False) -> DataFrame:
    """``(vec_id, neighbour_id, cosine)``: the k most similar other vectors of the same model.

    Equal cosines by smaller id.  A vector is usable if it has at least ``dim`` numbers (its
    length where dim is null), all of the first ``dim`` finite and not all zero; others give
    and get no row, nor do null ids.  Vectors of one model but other dims don't meet.  A
    repeated id counts once (of different vectors under one id, the one with the least
    digest).  Fewer than k others give fewer rows; further columns are not read; an empty
    input gives an empty result.  Copies of one vector are each other's first neighbours.
    ``exact`` compares every pair of a model in blocks, for small tables and to measure recall.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "similar")
    narrow = _usable(vectors, wide=False).groupBy("vec_id").agg(F.min(F.struct("model", "key")).alias("c")).select("vec_id", "c.model", "c.key")
    narrow = work.write(narrow, "ids")
    first = F.row_number().over(Window.partitionBy("model", "key").orderBy("vec_id"))
    classes = narrow.withColumn("rank", first).where(F.col("rank") <= k + 1).groupBy("model", "key").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = work.write(classes, "classes")
    counts = {r["model"]: r["n"] for r in classes.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}

    dims = {m: int(m.rsplit("|", 1)[1]) for m in counts}
    total = sum(n * dims[m] for m, n in counts.items())
    most = {m: max(1, int(LAYOUT_BYTES * n / max(1, total)) // 4) for m, n in counts.items()}  # of all bytes as large a share as the model has
    wanted = {m: 1 if exact else max(1, min(most[m], round(n / list_rows))) for m, n in counts.items()}
    layouts = _fitted(vectors, counts, wanted)
    sent = spark.sparkContext.broadcast(layouts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = np.array(b.column("model").to_pylist(), object)
            for m in np.unique(models) if len(models) else ():
                t = b.take(pa.array(np.flatnonzero(models == m)))
                layout = sent.value[m]
                near = layout.nearest(_flat(_blob(t.column("vec"), layout.dim)), probes)
                yield pa.RecordBatch.from_arrays([t.column("vec_id"), t.column("model"), t.column("vec"), pa.array(list(near), pa.list_(pa.int32()))], ["rep", "model", "vec", "lists"])

    reps = classes.select(F.col("rep").alias("vec_id"), F.col("key").alias("rep_key"))
    wide = _usable(vectors, wide=True).join(reps, "vec_id").where("key = rep_key").groupBy("vec_id").agg(F.first("model").alias("model"), F.first("vec").alias("vec"))
    placed = work.write(wide.mapInArrow(assign, "rep long, model string, vec binary, lists array<int>"), "placed")
    visits = placed.select("model", F.posexplode("lists").alias("turn", "list")).where("list >= 0").groupBy("model", "list").agg(F.count(F.lit(1)).alias("visits"), F.sum((F.col("turn") == 0).cast("int")).alias("members")).collect()
    key, spread = 0, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for m, layout in layouts.items():
        members, visiting = np.zeros(len(layout.c), np.int64), np.zeros(len(layout.c), np.int64)
        for r in visits:
            if r["model"] == m:
                members[r["list"]], visiting[r["list"]] = r["members"], r["visits"]
        # queries are spread over more tasks where there are few shards: smaller shards would leave them without a bar
        queries = min(shard_queries, QUERY_BYTES // (4 * layout.dim), max(LEAST_QUERIES, int(visiting.sum()) // spread))
        key = layout.share_out(members, visiting, key, max(1, min(shard_rows, SHARD_BYTES // (4 * layout.dim))), max(1, queries))
    sent = spark.sparkContext.broadcast(layouts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models, reps_, lists = b.column("model").to_pylist(), b.column("rep").to_pylist(), b.column("lists").to_pylist()
            row, keys, roles = [], [], []
            for i, (m, r, near) in enumerate(zip(models, reps_, lists, strict=True)):
                layout = sent.value[m]
                spread = hash((r, 1)) & 0xFFFFFFFF
                to: dict[int, int] = {}
                for ell in near:
                    if ell < 0:
                        break
                    for shard in layout.blocks.get(ell) or (int(layout.shard[ell]),):
                        start, n = layout.parts[shard]
                        to[start + spread % n] = 2
                own = layout.blocks.get(near[0])
                start, n = layout.parts[own[(hash((r, 2)) & 0xFFFFFFFF) % len(own)] if own else int(layout.shard[near[0]])]
                for part in range(start, start + n):
                    to[part] = to.get(part, 0) | 1
                row += [i] * len(to)
                keys += to.keys()
                roles += to.values()
            t = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(roles, pa.int32()), *(t.column(c) for c in ("rep", "model", "vec", "lists"))], ["key", "role", "rep", "model", "vec", "lists"])

    def search(t: pa.Table) -> pa.Table:
        m = t.column("model")[0].as_py()
        layout = sent.value[m]
        lists = np.array(t.column("lists").to_pylist(), np.int32).reshape(t.num_rows, -1)
        q, ids, cos = search_shard(layout, k, t.column("rep").to_numpy(), _blob(t.column("vec"), layout.dim), lists, t.column("role").to_numpy(), probes, list_rows, exact)
        have = ids >= 0
        some = have.any(axis=1)
        q, ids, cos, have = q[some], ids[some], cos[some], have[some]
        hits = pa.ListArray.from_arrays(pa.array(np.append(0, have.sum(axis=1).cumsum()), pa.int32()), pa.StructArray.from_arrays([pa.array(-cos[have]), pa.array(ids[have])], ["d", "id"]))
        return pa.table({"rep": pa.array(q), "hits": hits})

    routed = placed.mapInArrow(route, "key int, role int, rep long, model string, vec binary, lists array<int>")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(key, 10_000))
    hits = routed.repartition(tasks, "key").groupBy("key").applyInArrow(search, "rep long, hits array<struct<d: double, id: long>>")
    hits = work.write(hits, "hits")
    merged = hits.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))

    several = classes.where(F.size("ids") > 1).select(F.col("rep").alias("id"), "ids")
    away = merged.select("rep", F.inline("hits")).join(several, "id", "left").select("rep", "d", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    own = classes.select("rep", F.lit(-2.0).alias("d"), F.explode("ids").alias("id"))
    ranked = away.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, 2 * k + 2).alias("near"))
    # a vector may be copied without end: neither its copies nor their neighbours meet in one task
    n = narrow.count()
    copies = split_join(narrow, classes.where(F.size("ids") > 1).select("model", "key", "rep"), ["model", "key"], n, work).where("vec_id <> rep").select("vec_id", "rep")
    copies, ranked = work.write(copies, "copies"), work.write(ranked.select("rep", "near"), "near")
    everyone = ranked.select(F.col("rep").alias("vec_id"), "near").unionByName(split_join(copies, ranked, "rep", n, work).select("vec_id", "near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return everyone.select("vec_id", F.inline(others)).select("vec_id", F.col("id").alias("neighbour_id"), F.least(F.lit(1.0), -F.col("d")).alias("cosine"))
