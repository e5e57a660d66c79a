"""Vector operators: exact search in blocks, link generation, a static text embedder, content-addressed reuse, medoids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelattice.functions.text import stable_id
from codelattice.operators import predicates as P
from codelattice.operators.current import SQL, current_nodes, latest, whole_numbers
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table

TOP, THRESHOLD, DIM = 5, 0.60, 256
#: Query vectors sent to the tasks at once: 32 MB at 64 numbers.
BLOCK = 65_536
#: Distances held at once, and best rows of all queries that a task keeps.
CELLS, HELD = 2_000_000, 400_000
#: Pairs whose exact distance is taken at once.
PAIRS = 16_384


def squared_distance(a: Column, b: Column) -> Column:
    """Over the shorter one's numbers, in double precision, no root."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    squares = F.zip_with(x, y, lambda p, q: F.coalesce((p - q) * (p - q), F.lit(0.0)))
    return F.aggregate(squares, F.lit(0.0), lambda total, v: total + v)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    d = a.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(n > 0, F.transform(d, lambda v: v / n)).otherwise(d)


def _least_of_equal(x: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the ``n`` of the least ids, each id once: no more of them can be among the n - 1 nearest others."""
    _, group = np.unique(x, axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.lexsort((ids, group))
    g, v = group[order], ids[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
    order, g = order[new], g[new]
    keep = np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) < n])
    return x[keep], ids[keep]


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors of that length without nulls and non-finite numbers, by the array's offsets."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dim)
    if not len(at) or not dim:
        return at[:0], np.empty((0, dim))
    starts = np.asarray(column.offsets)[:-1].astype(np.int64)[at]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null number becomes NaN
    x = values[starts[:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def _best(row: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row by (score desc, id), each id once."""
    order = np.lexsort((vid, -score, row))
    row, vid, score = row[order], vid[order], score[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (vid[1:] != vid[:-1])] if len(row) else np.empty(0, bool)
    row, vid, score = row[new], vid[new], score[new]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], vid[keep], score[keep]


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the k nearest other vectors by 1 / (1 + squared distance), ties by id.

    ``vectors`` and ``queries`` have (vec_id, embedding) of one length; other lengths, nulls
    and non-finite numbers are left out.  The stated queries go to the data in blocks of
    bounded size; each partition keeps its best k over all its batches, and only those are shuffled.
    """
    spark = vectors.sparkSession
    found = None
    ids, rows = [], []
    block = min(block, max(1, HELD // k))

    def scan(ids: list[int], rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(rows, np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qi, q = sent.value
            qq = (q * q).sum(axis=1)
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for b in batches:
                at, x = _matrix(b.column("embedding"), q.shape[1])
                vi = b.column("vec_id").to_numpy(zero_copy_only=False)[at]
                if vi.dtype != np.int64:  # ids with nulls come as floats
                    some = ~np.isnan(vi)
                    x, vi = x[some], b.column("vec_id").take(pa.array(at[some])).to_numpy()
                if not len(x):
                    continue
                x, vi = _least_of_equal(x, vi, k + 1)
                xx = (x * x).sum(axis=1)
                width = max(16, CELLS // len(x))
                for i in range(0, len(q), width):
                    part, own = q[i : i + width], qi[i : i + width]
                    dist = np.maximum(0, qq[i : i + width, None] + xx[None, :] - 2 * part @ x.T)
                    dist[own[:, None] == vi[None, :]] = np.inf
                    m = min(k, len(x))
                    last = np.partition(dist, m - 1, axis=1)[:, m - 1]
                    # all that may tie with the k-th: the sum's own error, and scores that round alike
                    slack = 1e-12 * (1 + qq[i : i + width] + xx.max()) + 4e-9 * (1 + last) ** 2
                    row, col = np.nonzero(np.isfinite(dist) & (dist <= (last + slack)[:, None]))
                    if not len(row):
                        continue
                    exact = np.concatenate([((part[row[j : j + PAIRS]] - x[col[j : j + PAIRS]]) ** 2).sum(axis=1) for j in range(0, len(row), PAIRS)])
                    held.append(_best(row + i, vi[col], np.round(1 / (1 + exact), 9), k))
                    size += len(held[-1][0])
                if size > 2 * k * len(q):
                    held = [_best(*(np.concatenate(z) for z in zip(*held, strict=True)), k)]
                    size = len(held[0][0])
            if held:
                row, vi, score = _best(*(np.concatenate(z) for z in zip(*held, strict=True)), k)
                for i in range(0, len(row), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(qi[row[i : i + 100_000]]), pa.array(vi[i : i + 100_000]), pa.array(score[i : i + 100_000])], ["query_id", "vec_id", "score"])

        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "query_id long, vec_id long, score double")

    for r in queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("embedding IS NOT NULL AND vec_id IS NOT NULL").dropDuplicates(["vec_id"]).toLocalIterator():
        if (rows and len(r.embedding) != len(rows[0])) or None in r.embedding or not np.isfinite(r.embedding).all():
            continue
        ids.append(r.vec_id)
        rows.append(r.embedding)
        if len(rows) == block:
            found, ids, rows = scan(ids, rows) if found is None else found.unionByName(scan(ids, rows)), [], []
    if rows:
        found = scan(ids, rows) if found is None else found.unionByName(scan(ids, rows))
    if found is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Search profiles as (tables, planes); more tables find more, fewer planes compare more.  All of
#: them find nine of ten true neighbours even where those are hardly nearer than the rest.
PROFILES = {"accurate": (64, 6), "balanced": (56, 6), "fast": (48, 6)}
#: From how many vectors an approximate search pays.
ELECT_FROM = 10_000


def hashed_search(vectors: DataFrame, queries: DataFrame, k: int = TOP, profile: str = "balanced", seed: int = 3, spread: int = 8) -> DataFrame:
    """As ``exact_search``, by random hyperplanes: only vectors that share a bucket are compared, exactly.

    Buckets are (table, code); a query's bucket is joined to its members with a salt, so a
    bucket that holds a third of all vectors is spread over ``spread`` tasks.  Buckets hold
    ids; a pair's vectors are fetched once, for its distance.  Vectors of different lengths
    never meet.
    """
    tables, planes = PROFILES[profile]

    def coded(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            normals: dict[int, np.ndarray] = {}
            for b in batches:
                for dim in np.unique(np.asarray(b.column("embedding").value_lengths().fill_null(0))).tolist():
                    at, x = _matrix(b.column("embedding"), dim)
                    if not len(at):
                        continue
                    if dim not in normals:
                        normals[dim] = np.random.default_rng(seed * 100_003 + dim).normal(size=(dim, tables * planes))
                    bits = (x @ normals[dim] > 0).reshape(len(x), tables, planes)
                    codes = (bits * (1 << np.arange(planes))).sum(axis=2) + (np.arange(tables) << planes) + dim * (tables << planes)
                    own = pa.array(np.repeat(at, tables))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(own), pa.array(codes.reshape(-1).astype(np.int64))], ["id", "bucket"])

        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "id long, bucket long").select(F.col("id").alias(name), "bucket")

    members = coded(vectors, "vec_id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(spread)).cast("int"))
    asked = coded(queries, "query_id").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(spread)])))
    pairs = asked.join(members, ["bucket", "salt"]).where("query_id <> vec_id").select("query_id", "vec_id").distinct()
    of = lambda df, name: df.select(F.col("vec_id").cast("long").alias(name), F.col("embedding").cast("array<double>").alias(name + "_v")).where(f"{name} IS NOT NULL").dropDuplicates([name])
    pairs = pairs.join(of(queries, "query_id"), "query_id").join(of(vectors, "vec_id"), "vec_id")
    scored = pairs.select("query_id", "vec_id", F.round(1 / (1 + squared_distance(F.col("query_id_v"), F.col("vec_id_v"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, profile: str = "default") -> DataFrame:
    """Exact below ``ELECT_FROM`` vectors or with the default profile, else hashed."""
    if profile == "default" or vectors.count() < ELECT_FROM:
        return exact_search(vectors, queries, k)
    return hashed_search(vectors, queries, k, profile)


def links(hits: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """SIMILAR_TO links from search hits (src, dst, score): the top k come first, then the filters.

    Dropped are hits below the threshold, targets that are no symbols, pairs in one file and idiomatic names.
    """
    n = nodes.select("node_id", "symbol_path", "kind", "file_path")
    a, b = (n.select(*[F.col(c).alias(f"{p}_{c}") for c in n.columns]) for p in ("a", "b"))
    j = hits.where(F.col("score") >= threshold).join(a, F.col("src") == F.col("a_node_id")).join(b, F.col("dst") == F.col("b_node_id"))
    last = lambda c: P.last_segment(F.col(c))
    idiom = (last("a_symbol_path") == last("b_symbol_path")) & last("a_symbol_path").isin(*P.IDIOMATIC_NAMES) | ((F.col("a_kind") == "variable") & (F.col("b_kind") == "variable") & F.col("a_symbol_path").endswith("Cmd") & F.col("b_symbol_path").endswith("Cmd"))
    keep = ~F.col("b_kind").isin(*P.CLONE_EXCLUDED_KINDS) & ~F.coalesce(F.col("a_file_path") == F.col("b_file_path"), F.lit(False)) & ~F.coalesce(idiom, F.lit(False))
    edge = stable_id(F.col("src"), F.lit("SIMILAR_TO"), F.col("dst"), length=32)
    return j.where(keep).select(edge.alias("edge_id"), "src", "dst", F.lit("unresolved").alias("confidence"), F.col("score").cast("float").alias("score"))


def embed_text(kind: Column, symbol: Column, path: Column, language: Column, signature: Column) -> Column:
    parts = [F.nullif(c, F.lit("")) for c in (kind, symbol, path, language, signature)]
    return F.concat_ws(" ", *parts)


def static_embedding(dim: int = DIM):
    """Arrow UDF: text -> unit vector of hashed word pieces (the word and its 3- to 6-grams); empty text gives zeros."""
    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        cache: dict[str, np.ndarray] = {}

        def word(w: str) -> np.ndarray:
            if w not in cache:
                padded = f"<{w}>"
                grams = [w, *(padded[i : i + n] for n in range(3, 7) for i in range(len(padded) - n + 1))]
                v = np.zeros(dim)
                for g in grams:
                    h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                    v[h % dim] += 1 if h >> 40 & 1 else -1
                cache[w] = v / len(grams)
            return cache[w]

        def one(t: str | None) -> list[float]:
            ws = re.findall(r"[A-Za-z]+|\d+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t or ""))
            v = sum((word(w.lower()) for w in ws), np.zeros(dim))
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return text.map(one)

    return embed


def embed_new(texts: DataFrame, store: DataFrame, model: str, dim: int = DIM) -> DataFrame:
    """Vectors for texts the store lacks: content-addressed by model and text, each distinct text embedded once.

    ``texts`` (id, text), ``store`` (embed_hash) -> (embed_hash, model, embedding).
    """
    keyed = texts.select(stable_id(F.lit(model), F.col("text")).alias("embed_hash"), "text").dropDuplicates(["embed_hash"])
    fresh = keyed.join(store.select("embed_hash").distinct(), "embed_hash", "left_anti")
    return fresh.select("embed_hash", F.lit(model).alias("model"), static_embedding(dim)("text").alias("embedding"))


def condense(parts: DataFrame, k: int = 3) -> DataFrame:
    """The k parts of each group (group, place, embedding) most like the group as a whole, in their order.

    The mean dot product with all parts is the dot product with the group's mean, so no pairs are made.
    """
    mean = parts.select("group", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("group", "i").agg(F.avg("x").alias("x")).groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    dot = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.col("mean"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    w = Window.partitionBy("group").orderBy(F.round(dot, 9).desc(), "place")
    return parts.join(mean, "group").withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k).drop("mean", "r_")


def _queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 20 = 0")


def knn_links(spark: SparkSession, d: str) -> DataFrame:
    v, q = _queries(spark, d)
    return exact_search(v, q).where("score >= 0.45").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_top(spark: SparkSession, d: str) -> DataFrame:
    v, q = _queries(spark, d)
    return exact_search(v, q, 10).select("query_id", "vec_id", "rank")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    n = F.aggregate(normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x * x)
    return v.select("vec_id", F.round(n, 6).alias("unit"), F.round(squared_distance(F.col("embedding"), F.reverse("embedding")), 5).alias("to_reverse"))


def label_medoids(spark: SparkSession, d: str) -> DataFrame:
    """The three vectors of each label that stand nearest to all of it."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("place"), "embedding")
    return condense(v).select(F.col("group").alias("label"), F.col("place").alias("vec_id"))


def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Texts of nodes that no stored vector covers: how many a kind, each distinct text once."""
    n = current_nodes(table(spark, d, "nodes"))
    have = latest(table(spark, d, "node_vectors"), ["vec_id"], [F.col("embedded_at").desc()]).select("node_id").where("node_id IS NOT NULL").distinct()
    t = n.join(have, "node_id", "left_anti").select("kind", embed_text(*(F.col(c) for c in ("kind", "symbol_path", "file_path", "language", "signature"))).alias("text"))
    return t.groupBy("kind").agg(F.count_distinct("text").alias("texts"))


def _node_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, node_id, embedding) of unit length: the latest usable vector of each node of the main branch, of the elected model."""
    from codelattice.operators.clones import elected_model

    model = elected_model(spark, d).first()["model"]
    e = F.slice("embedding", 1, F.col("dim"))
    ok = F.size(e) == F.col("dim")
    ok = ok & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0)
    v = table(spark, d, "node_vectors").where((F.col("model") == model) & F.col("node_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    v = latest(v, ["node_id"], [F.col("embedded_at").desc_nulls_last(), F.col("vec_id").asc()]).select("vec_id", "node_id", normalised(e).alias("embedding"))
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'").select("node_id")
    return Workspace(spark, "vectors").write(v.join(n, "node_id", "left_semi"), "vectors")


def _similar(v: DataFrame, asked: DataFrame, k: int = TOP) -> DataFrame:
    """(src, dst, score, rank) of the nodes ``asked`` (node_id) among ``v``; a node without a vector gives no row."""
    q = v.join(asked.select("node_id").distinct(), "node_id", "left_semi")
    hits = exact_search(v, q, k)
    names = v.select("vec_id", "node_id")
    return hits.join(names.toDF("query_id", "src"), "query_id").join(names.toDF("vec_id", "dst"), "vec_id").select("src", "dst", "score", "rank")


def similar_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The five nodes most similar to each node asked for (every twentieth vector), itself left out."""
    v = _node_vectors(spark, d)
    return _similar(v, v.where("vec_id % 20 = 0")).select("src", "dst", F.round("score", 6).alias("score"), "rank")


def related_lines(spark: SparkSession, d: str) -> DataFrame:
    """What is related to a line: the symbol around the first line of each call, then the nodes most similar to it, or that it is not embedded."""
    from codelattice.operators.lookup import enclosing_span

    v = _node_vectors(spark, d)
    lines = enclosing_span(spark, d).where("branch = 'main' AND line % 20 = 0")
    lines = Workspace(spark, "lines").write(lines.select("repo_id", "file_path", "line", F.col("node_id").alias("src")), "lines")
    hits = _similar(v, lines.select(F.col("src").alias("node_id")), 1)
    return lines.join(hits, "src", "left").select("repo_id", "file_path", "line", "src", F.coalesce("dst", F.lit("not embedded")).alias("related"))


def generated_links(spark: SparkSession, d: str) -> DataFrame:
    """SIMILAR_TO links of each node asked for: the top five first, then threshold, kinds, files and idiomatic names."""
    v = _node_vectors(spark, d)
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    return links(_similar(v, v.where("vec_id % 20 = 0")), n).select("edge_id", "src", "dst", "confidence", F.round(F.col("score").cast("double"), 4).alias("score"))


def backend_election(spark: SparkSession, d: str) -> DataFrame:
    """Exact or approximate search by the largest repo's vectors: one row."""
    v = table(spark, d, "node_vectors").where("node_id IS NOT NULL").select("node_id", "vec_id").distinct()
    n = current_nodes(table(spark, d, "nodes")).select("node_id", "repo_id").distinct()
    g = v.join(n, "node_id").groupBy("repo_id").agg(F.count_distinct("vec_id").alias("vectors"))
    return g.agg(F.coalesce(F.max("vectors"), F.lit(0)).alias("largest")).select("largest", F.when(F.col("largest") >= ELECT_FROM, "hashed").otherwise("exact").alias("backend"))


def profile_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether each profile of the approximate search finds at least nine of ten true neighbours, measured on every twentieth vector against all."""
    v, q = _queries(spark, d)
    work = Workspace(spark, "recall")
    true = work.write(exact_search(v, q).select("query_id", "vec_id"), "true")
    out = None
    for profile in PROFILES:
        hits = hashed_search(v, q, TOP, profile).select("query_id", "vec_id", F.lit(1).alias("hit"))
        one = true.join(hits, ["query_id", "vec_id"], "left").agg((F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("enough")).select(F.lit(profile).alias("profile"), "enough")
        out = one if out is None else out.unionByName(one)
    return out


_NV = f"""nv AS (SELECT node_id, vec_id, list_transform(embedding[1:dim]::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding[1:dim]::DOUBLE[], embedding[1:dim]::DOUBLE[]))) AS e FROM node_vectors v
 WHERE model = (SELECT model FROM node_vectors GROUP BY 1 ORDER BY count(DISTINCT vec_id) DESC, model LIMIT 1) AND node_id IS NOT NULL AND len(embedding) >= dim AND len(list_filter(embedding[1:dim], lambda x: x IS NULL OR isnan(x))) = 0
 AND len(list_filter(embedding[1:dim], lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY embedded_at DESC NULLS LAST, vec_id) = 1),
u AS (SELECT * FROM nv WHERE EXISTS (SELECT 1 FROM cn WHERE cn.node_id = nv.node_id AND cn.branch = 'main'))"""
_HITS = """h AS (SELECT a.node_id AS src, b.node_id AS dst, round(1 / (1 + pow(list_distance(a.e, b.e), 2)), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 / (1 + pow(list_distance(a.e, b.e), 2)), 9) DESC, b.vec_id) AS rank FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE {0})"""
_DIST = "pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2)"
_KNN = f"SELECT q.vec_id AS query_id, v.vec_id, round(1 / (1 + {_DIST}), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 / (1 + {_DIST}), 9) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"
QUERIES = {f.__name__: f for f in (knn_links, knn_top, vector_norms, label_medoids, embed_pending, similar_nodes, related_lines, generated_links, backend_election, profile_recall)}
ORACLE = {
    "knn_links": f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_KNN}) WHERE rank <= 5 AND score >= 0.45",
    "knn_top": f"SELECT query_id, vec_id, rank FROM ({_KNN}) WHERE rank <= 10",
    "similar_nodes": whole_numbers(f"WITH {SQL}, {_NV}, {_HITS.format('a.vec_id % 20 = 0')} SELECT src, dst, round(score, 6) AS score, rank FROM h WHERE rank <= 5", "rank"),
    "related_lines": f"""WITH {SQL}, {_NV}, p AS (SELECT DISTINCT n.repo_id, n.file_path, e.src_line AS line FROM edges e JOIN cn n ON n.node_id = e.src_node_id AND n.branch = e.branch WHERE e.src_line > 0 AND e.src_line % 20 = 0 AND n.branch = 'main' AND n.kind IN ('function', 'method')),
l AS (SELECT p.repo_id, p.file_path, p.line, arg_min(n.node_id, (n.line_end - n.line_start, n.node_id)) AS src FROM p JOIN cn n ON n.repo_id = p.repo_id AND n.branch = 'main' AND n.file_path = p.file_path AND p.line BETWEEN n.line_start AND n.line_end AND n.line_start > 0 AND n.kind NOT IN ('file', 'package', 'module') GROUP BY 1, 2, 3),
{_HITS.format("a.node_id IN (SELECT src FROM l)")} SELECT l.*, coalesce(h.dst, 'not embedded') AS related FROM l LEFT JOIN h ON h.src = l.src AND h.rank = 1""",
    "generated_links": f"""WITH {SQL}, {_NV}, {_HITS.format('a.vec_id % 20 = 0')}, j AS (SELECT h.*, split_part(a.symbol_path, '.', -1) AS la, split_part(b.symbol_path, '.', -1) AS lb, a.kind AS ka, b.kind AS kb, a.symbol_path AS sa, b.symbol_path AS sb, a.file_path AS fa, b.file_path AS fb FROM h JOIN cn a ON a.node_id = h.src AND a.branch = 'main' JOIN cn b ON b.node_id = h.dst AND b.branch = 'main' WHERE h.rank <= 5 AND h.score >= 0.6)
SELECT substr(sha256(src || chr(0) || 'SIMILAR_TO' || chr(0) || dst), 1, 32) AS edge_id, src, dst, 'unresolved' AS confidence, round(score::FLOAT::DOUBLE, 4) AS score FROM j WHERE kb NOT IN ('package', 'chunk', 'file', 'module', 'field', 'import') AND NOT coalesce(fa = fb, false)
AND NOT coalesce(la = lb AND la IN ('init', 'main', 'String', 'Error', 'TestMain') OR ka = 'variable' AND kb = 'variable' AND ends_with(sa, 'Cmd') AND ends_with(sb, 'Cmd'), false)""",
    "backend_election": f"WITH {SQL}, g AS (SELECT repo_id, count(DISTINCT vec_id) AS n FROM node_vectors v JOIN (SELECT DISTINCT node_id, repo_id FROM cn) c USING (node_id) GROUP BY 1) SELECT coalesce(max(n), 0) AS largest, CASE WHEN max(n) >= 10000 THEN 'hashed' ELSE 'exact' END AS backend FROM g",
    "profile_recall": "SELECT * FROM (VALUES ('accurate', true), ('balanced', true), ('fast', true)) r(profile, enough)",
    "vector_norms": "SELECT vec_id, 1.0::DOUBLE AS unit, round(pow(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 2), 5) AS to_reverse FROM embeddings",
    "label_medoids": """WITH d AS (SELECT a.label, a.vec_id, row_number() OVER (PARTITION BY a.label ORDER BY round(avg(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) DESC, a.vec_id) AS r
 FROM embeddings a JOIN embeddings b USING (label) GROUP BY 1, 2) SELECT label, vec_id FROM d WHERE r <= 3""",
    "embed_pending": f"WITH {SQL} SELECT kind, count(DISTINCT concat_ws(' ', nullif(kind, ''), nullif(symbol_path, ''), nullif(file_path, ''), nullif(language, ''), nullif(signature, ''))) AS texts FROM cn n WHERE NOT EXISTS (SELECT 1 FROM node_vectors v WHERE v.node_id = n.node_id) GROUP BY 1",
}
ORACLE["knn_links"] = whole_numbers(ORACLE["knn_links"], "rank")
ORACLE["knn_top"] = whole_numbers(ORACLE["knn_top"], "rank")
