"""Graph traversal over edge tables: bounded breadth-first search, chains, components of strong connection."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codelattice.operators import predicates as P
from codelattice.operators.current import SQL, current_edges, current_nodes
from codelattice.operators.lookup import _open
from codelattice.plans.identify import number_ids
from codelattice.plans.materialize import Workspace
from codelattice.plans.skew import split_join
from codelattice.sources.tables import table

DEPTH, MAX_DEPTH, NODE_CAP, HUB = 3, 10, 200, 50
AS_OF, BASE_TIME = "2026-07-01", "2026-03-01"
#: Edges that one task searches for strong components: as longs, and with their ids as they are.
FINISH, DIRECT = 2_000_000, 100_000


def steps(edges: DataFrame, direction: str = "callers") -> DataFrame:
    """(at, to) of one hop; callers walk edges backwards.  Parallel edges stay: they count for the hub gate."""
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    ahead = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    return {"callers": back, "callees": ahead, "both": back.unionByName(ahead)}[direction]


def blast_radius(edges: DataFrame, seeds: DataFrame, direction: str = "callers", depth: int | None = DEPTH, hub: int | None = HUB, cap: int | None = None, mark: bool = False) -> DataFrame:
    """Nodes within ``depth`` hops of each origin: ``(origin, node, distance, is_hub)``, seeds at 0.

    ``seeds`` (origin, node): many origins walk together, one join a hop over the whole
    frontier.  A node with more than ``hub`` neighbour entries is reported but not expanded.
    ``cap`` keeps the first nodes of each origin by (distance, node) after each hop; with ``mark``
    a further column ``truncated`` says of each origin whether that cut anything.
    Without a ``depth`` the walk goes on until a hop brings nothing new.
    Null ends and seeds are left out; seeds without edges stay.
    """
    work = Workspace(edges.sparkSession, "blast")
    hops = steps(edges.where("src IS NOT NULL AND dst IS NOT NULL"), direction)
    degree = hops.groupBy("at").agg(F.count(F.lit(1)).alias("deg"))
    hubs = work.write(degree.where(F.col("deg") > hub).select(F.col("at").alias("node")), "hubs") if hub is not None else None
    moves = hops.where("at <> to").distinct()
    if hubs is not None:
        moves = moves.join(hubs.select(F.col("node").alias("at")), "at", "left_anti")
    moves = work.write(moves, "moves")
    seen = work.write(seeds.where("node IS NOT NULL").select("origin", "node").distinct().withColumn("distance", F.lit(0)), "seen")
    for hop in count(1) if depth is None else range(1, min(depth, MAX_DEPTH) + 1):
        front = seen.where(F.col("distance") == hop - 1)
        new = front.join(moves, front["node"] == moves["at"]).select("origin", F.col("to").alias("node")).distinct()
        new = new.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("distance", F.lit(hop))
        grown = seen.unionByName(new)
        if cap is not None:
            w = Window.partitionBy("origin").orderBy("distance", "node")
            grown = grown.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= cap + 1).drop("rn_")  # one more tells that there are more
        old, seen = seen, work.write(grown, "seen")
        work.drop(old)
        if depth is None and seen.where(F.col("distance") == hop).isEmpty():
            break
    columns = ["origin", "node", "distance", F.coalesce("is_hub", F.lit(False)).alias("is_hub")]
    if cap is not None:
        all_of = Window.partitionBy("origin")
        place = F.row_number().over(all_of.orderBy("distance", "node"))
        seen = seen.withColumn("rn_", place).withColumn("truncated", F.max("rn_").over(all_of) > cap).where(F.col("rn_") <= cap).drop("rn_")
    elif mark:
        seen = seen.withColumn("truncated", F.lit(False))
    if mark:
        columns.append("truncated")
    if hubs is None:
        return seen.withColumn("is_hub", F.lit(False)).select(*columns)
    return seen.join(hubs.withColumn("is_hub", F.lit(True)), "node", "left").select(*columns)


def _tarjan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strong components of a bounded edge set (src, dst), ids of any one type, depth first without recursion."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    n_edges = t.num_rows
    coded = pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks]).combine_chunks().dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary)
    names, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))  # in the order of the ids
    ends = place[coded.indices.to_numpy()]
    src, dst = ends[:n_edges], ends[n_edges:]
    n = len(names)
    to = dst[np.argsort(src, kind="stable")].tolist()
    at = np.append(0, np.cumsum(np.bincount(src, minlength=n))).tolist()
    stop = at[1:]
    number, low, on = [-1] * n, [0] * n, bytearray(n)
    stack, nodes, parts, seen = [], [], [], 0
    for start in range(n):
        if number[start] >= 0:
            continue
        number[start] = low[start] = seen
        seen += 1
        stack.append(start)
        on[start] = 1
        work = [start]
        while work:
            v = work[-1]
            i = at[v]
            if i < stop[v]:
                at[v] = i + 1
                w = to[i]
                if number[w] < 0:
                    number[w] = low[w] = seen
                    seen += 1
                    stack.append(w)
                    on[w] = 1
                    work.append(w)
                elif on[w] and number[w] < low[v]:
                    low[v] = number[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == number[v]:
                first = len(nodes)
                while True:
                    w = stack.pop()
                    on[w] = 0
                    nodes.append(w)
                    if w == v:
                        break
                if len(nodes) - first > 1:
                    parts += [min(nodes[first:])] * (len(nodes) - first)
                else:
                    nodes.pop()
    if nodes:
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (nodes, parts)], ["node", "component"])


def strong_components(edges: DataFrame, max_rounds: int = 200, finish: int = FINISH, direct: int = DIRECT) -> DataFrame:
    """Strongly connected components of two or more nodes: (node, component), component its least node.

    At most ``direct`` edges go to one task as they are.  Beyond, ids become longs, and trimming
    takes off nodes without a way in or out as long as that removes much.  What is left goes to
    one task once it fits the fixed bound ``finish``; until then every node learns the least node
    that reaches it and that it reaches; those that agree are a component and go.  The others
    fall into groups by what they learnt: groups that fit ``finish`` go to tasks side by side, the
    rest goes on.  Ids are strings; self-loops and null ends don't count.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "strong")
    named = work.write(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    n_named = n = named.count()
    if n <= min(direct, finish):
        return named.coalesce(1).mapInArrow(_tarjan, "node string, component string")
    ids = number_ids(named.select(F.col("src").alias("id")).unionByName(named.select(F.col("dst").alias("id"))), "id", work, "ids")
    half = work.write(split_join(named, ids.toDF("src", "s"), "src", n, work).select("s", "dst"), "half")
    e = work.write(split_join(half, ids.toDF("dst", "d"), "dst", n, work).select(F.col("s").alias("src"), F.col("d").alias("dst")), "numbered")
    work.drop(half)
    work.drop(named)
    parts, fields = [], "node long, component long"
    for _ in range(max_rounds):
        while n > finish:  # trim
            t = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            t = work.write(t, "trimmed")
            work.drop(e)
            e, before, n = t, n, t.count()
            if n > 0.9 * before:  # a long way in would lose a node a round
                break
        if n <= finish:
            parts.append(work.write(e.coalesce(1).mapInArrow(_tarjan, fields), "last"))
            break
        ahead, back = _least_reaching(e, "src", "dst", n, work), _least_reaching(e, "dst", "src", n, work)
        both = work.write(ahead.withColumnRenamed("least", "f").join(back.withColumnRenamed("least", "b"), "node"), "colours")
        parts.append(both.where("f = b").select("node", F.col("f").alias("component")))
        c = both.where("f <> b").select("node", "f", "b")
        rest = e.join(c.toDF("src", "f", "b"), "src").join(c.toDF("dst", "f2", "b2"), "dst").where("f = f2 AND b = b2").select("src", "dst", "f", "b")
        rest = work.write(rest, "rest")
        work.drop(e)
        wide = work.write(rest.groupBy("f", "b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > finish).select("f", "b"), "wide")  # at most n / finish
        small = rest.join(F.broadcast(wide), ["f", "b"], "left_anti") if finish else rest.limit(0)
        spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), n // max(1, finish))
        parts.append(work.write(small.repartition(spread, "f", "b").select("src", "dst").mapInArrow(_tarjan, fields), "groups"))
        e = work.write((rest.join(F.broadcast(wide), ["f", "b"], "left_semi") if finish else rest).select("src", "dst"), "rest")
        work.drop(rest)
        n = e.count()
    else:
        raise RuntimeError("components did not settle")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = work.write(found.join(ids.toDF("name", "node"), "node").select(F.col("name").alias("node"), F.col("component").alias("c")), "found")
    least = found.groupBy("c").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("k")).where("k >= 2").select("c", "component")
    return split_join(found, least, "c", n_named, work).select("node", "component")


def _least_reaching(e: DataFrame, a: str, b: str, n: int, work: Workspace) -> DataFrame:
    """For each node the least node with a way to it along a -> b, itself included.

    Whatever reaches a node's least node reaches the node, so labels are also taken from
    the node they name: long ways need few rounds.  Hubs and common labels are split off.
    """
    least = e.select(F.col(a).alias("node")).unionByName(e.select(F.col(b).alias("node"))).distinct().withColumn("least", F.col("node"))
    least = work.write(least, "least")
    while True:
        came = split_join(e, least.select(F.col("node").alias(a), "least"), a, n, work).groupBy(F.col(b).alias("node")).agg(F.min("least").alias("came"))
        step = work.write(least.join(came, "node", "left").select("node", F.least("least", F.coalesce("came", "least")).alias("low"), "least"), "step")
        jumped = split_join(step, least.select(F.col("node").alias("low"), F.col("least").alias("lower")), "low", n, work)
        new = work.write(jumped.select("node", F.least("low", "lower").alias("new"), "least"), "least")
        work.drop(step)
        if new.where("new <> least").isEmpty():
            return new.select("node", F.col("new").alias("least"))
        work.drop(least)
        least, at = new.select("node", F.col("new").alias("least")), new._written_at
        least._written_at = at


def _main_edges(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Edges of the main branch with both ends there."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'").select("node_id")
    e = current_edges(table(spark, d, "edges")).where("branch = 'main'")
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    e = e.join(n.select(F.col("node_id").alias("src_node_id")), "src_node_id", "left_semi").join(n.select(F.col("node_id").alias("dst_node_id")), "dst_node_id", "left_semi")
    return e.select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"), "kind", "edge_id")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of open findings of high or critical severity on the main branch, one origin for all."""
    f = _open(spark, d).where("state = 'open' AND severity IN ('high', 'critical') AND branch = 'main' AND node_id IS NOT NULL")
    return f.select(F.lit("all").alias("origin"), F.col("node_id").alias("node")).distinct()


def blast_radius_callers(spark: SparkSession, d: str) -> DataFrame:
    return blast_radius(_main_edges(spark, d), _seeds(spark, d), hub=HUB).select("node", "distance", "is_hub")


def blast_radius_both(spark: SparkSession, d: str) -> DataFrame:
    return blast_radius(_main_edges(spark, d, "calls", "similarto"), _seeds(spark, d), "both", depth=2, hub=20).select("node", "distance", "is_hub")


def call_chain(spark: SparkSession, d: str) -> DataFrame:
    """CALLS edges on the way out of the seeds within three hops, seeds' own distance 0."""
    e = Workspace(spark, "chain").write(_main_edges(spark, d, "calls").select("src", "dst").distinct(), "edges")
    seen = blast_radius(e, _seeds(spark, d), "callees", hub=None)
    near = seen.where(F.col("distance") < DEPTH).select(F.col("node").alias("src"), "distance")
    return e.join(near, "src").select("src", "dst", (F.col("distance") + 1).alias("hop"))


def covering(calls: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Test entry points that reach a seed over any number of calls: ``(node, distance)``.

    An entry point is a function of a test file that the test runner starts by its name; it
    is not walked through unless it is a seed itself.  Helpers in test files are no tests: they are.
    """
    entry = P.is_test_file(F.col("file_path")) & (F.col("kind") == "function") & F.coalesce(P.is_go_test_name(F.col("symbol_path")), F.lit(False))
    tests = nodes.where(entry).select(F.col("node_id").alias("node")).distinct()
    ends = tests.join(seeds.select("node"), "node", "left_anti")
    through = calls.join(ends.select(F.col("node").alias("dst")), "dst", "left_anti")
    seen = blast_radius(through.select("src", "dst"), seeds, depth=None, hub=None)
    return seen.join(tests, "node", "left_semi").select("node", "distance")


def tests_covering(spark: SparkSession, d: str) -> DataFrame:
    """Test entry points that reach a seed over CALLS, however far."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    return covering(_main_edges(spark, d, "calls").select("src", "dst"), n, _seeds(spark, d))


def fan_in(spark: SparkSession, d: str) -> DataFrame:
    e = _main_edges(spark, d)
    return e.groupBy(F.col("dst").alias("node_id"), "kind").agg(F.count(F.lit(1)).alias("inbound"), F.count_distinct("src").alias("sources"))


def file_reach(edges: DataFrame, nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """What each file's symbols reach as callers within the usual depth, over edges of every kind: (origin, node, distance), origin repo:path.

    ``nodes`` (node_id, repo_id, file_path) are the files' symbols of every kind; rows without a path are left out.
    """
    seeds = nodes.where("file_path IS NOT NULL").select(F.concat_ws(":", "repo_id", "file_path").alias("origin"), F.col("node_id").alias("node"))
    return blast_radius(edges.select("src", "dst"), seeds, cap=cap).select("origin", "node", "distance")


def hot_zones(spark: SparkSession, d: str) -> DataFrame:
    """Files by commits of the last 30 days times blast size at default depth and cap: one search from all of every file's symbols at once, top 20."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    changes = recent_changes(table(spark, d, "nodes").where("branch = 'main'"))
    busy = n.join(changes.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi")
    size = file_reach(_main_edges(spark, d), busy, NODE_CAP).groupBy("origin").agg(F.count(F.lit(1)).alias("blast"))
    z = changes.withColumn("origin", F.concat_ws(":", "repo_id", "file_path")).join(size, "origin").select("repo_id", "file_path", "changes", "blast", (F.col("changes") * F.col("blast")).alias("score")).where("score > 0")
    return z.orderBy(F.col("score").desc(), "repo_id", "file_path").limit(20)


def recent_changes(nodes: DataFrame, as_of: str = AS_OF, days: int = 30) -> DataFrame:
    """(repo_id, file_path, changes): commits that touched a file within the window; a promotion stands for its commit."""
    t = F.lit(as_of).cast("timestamp_ntz")
    inside = nodes.where(F.col("file_path").isNotNull() & (F.col("last_promoted_at") > t - F.expr(f"INTERVAL {days} DAYS")) & (F.col("last_promoted_at") <= t))
    return inside.groupBy("repo_id", "file_path").agg(F.count_distinct("last_promoted_at").alias("changes"))


def blast_radius_each(spark: SparkSession, d: str) -> DataFrame:
    """The neighbourhood of every seed by itself, with the default depth, cap and hub gate, and whether the cap cut it."""
    seeds = _seeds(spark, d).select(F.col("node").alias("origin"), "node")
    return blast_radius(_main_edges(spark, d), seeds, cap=NODE_CAP, mark=True)


def dirty_blast(spark: SparkSession, d: str) -> DataFrame:
    """What each repo's staged nodes reach: seeds are nodes promoted since the base time whose content differs from what stood then."""
    n = table(spark, d, "nodes").where("branch = 'main'")
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    old = current_nodes(n.where(F.col("last_promoted_at") <= t)).select("node_id", F.col("content_hash").alias("old"))
    staged = current_nodes(n.where(F.col("last_promoted_at") > t)).join(old, "node_id", "left").where("old IS NULL OR old = '' OR content_hash IS NULL OR content_hash <> old")
    seeds = staged.select(F.col("repo_id").alias("origin"), F.col("node_id").alias("node"))
    return blast_radius(_main_edges(spark, d), seeds, depth=2, cap=NODE_CAP, mark=True)


def call_moves(calls: DataFrame, kinds: DataFrame, direction: str) -> DataFrame:
    """(src, dst, at, to): call edges with the step they allow; inbound steps never lead to a package, file, module or chunk.

    ``calls`` (src, dst), ``kinds`` (node, kind); direction in, out or both.
    """
    ahead = calls.select("src", "dst", F.col("src").alias("at"), F.col("dst").alias("to"))
    boxes = kinds.where(F.col("kind").isin(*P.CONTAINER_KINDS)).select(F.col("node").alias("src"))
    back = calls.join(boxes, "src", "left_anti").select("src", "dst", F.col("dst").alias("at"), F.col("src").alias("to"))
    return {"out": ahead, "in": back, "both": ahead.unionByName(back)}[direction]


def call_edges(calls: DataFrame, kinds: DataFrame, seeds: DataFrame, direction: str = "out", depth: int = DEPTH) -> DataFrame:
    """(src, dst, hop): the call edges met on a walk from the seeds (origin, node), each once, with the hop that met it first."""
    moves = Workspace(calls.sparkSession, "chain").write(call_moves(calls, kinds, direction).distinct(), "moves")
    seen = blast_radius(moves.select(F.col("at").alias("src"), F.col("to").alias("dst")), seeds, "callees", depth=depth, hub=None)
    near = seen.where(F.col("distance") < depth).select(F.col("node").alias("at"), "distance")
    return moves.join(near, "at").groupBy("src", "dst").agg((F.min("distance") + 1).alias("hop"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return current_nodes(table(spark, d, "nodes")).where("branch = 'main'").select(F.col("node_id").alias("node"), "kind")


def call_chain_in(spark: SparkSession, d: str) -> DataFrame:
    return call_edges(_main_edges(spark, d, "calls").select("src", "dst").distinct(), _kinds(spark, d), _seeds(spark, d), "in")


def call_chain_both(spark: SparkSession, d: str) -> DataFrame:
    return call_edges(_main_edges(spark, d, "calls").select("src", "dst").distinct(), _kinds(spark, d), _seeds(spark, d), "both", depth=2)


def caller_files(spark: SparkSession, d: str) -> DataFrame:
    """How many files, and test files among them, call each node: base and candidate callers together."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'").select(F.col("node_id").alias("src"), "repo_id", "file_path")
    e = _main_edges(spark, d, "calls").select("src", "dst").where("src <> dst").distinct()
    files = F.struct("repo_id", "file_path")
    return e.join(n, "src").where("file_path IS NOT NULL").groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct(files).alias("files"), F.count_distinct(F.when(P.is_test_file(F.col("file_path")), files)).alias("test_files"))


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by inbound edges: no open finding, no test, no Go init; top 50."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'").where(F.col("kind").isin("function", "method", "class", "struct", "interface", "type", "command", "route"))
    bad = _open(spark, d).where("state = 'open' AND branch = 'main'").select("node_id")
    n = n.join(bad, "node_id", "left_anti").where(~P.is_test_file(F.col("file_path")) & ~F.coalesce((F.col("language") == "go") & (F.col("symbol_path") == "init"), F.lit(False)))
    inbound = _main_edges(spark, d).groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("inbound"))
    out = n.join(inbound, "node_id", "left").select("node_id", "symbol_path", "kind", F.coalesce("exported", F.lit(False)).alias("exported"), F.coalesce("inbound", F.lit(0)).alias("inbound"))
    return out.orderBy(F.col("inbound").desc(), F.col("exported").desc(), F.col("symbol_path").asc_nulls_last(), "node_id").limit(50)


def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Call and import cycles of the main branch."""
    return strong_components(_main_edges(spark, d, "calls", "imports", "dependson").select("src", "dst"))


_ME = "me AS (SELECT e.src_node_id AS src, e.dst_node_id AS dst, e.kind, e.edge_id FROM ce e WHERE e.branch = 'main' AND e.src_node_id IN (SELECT node_id FROM cn WHERE branch = 'main') AND e.dst_node_id IN (SELECT node_id FROM cn WHERE branch = 'main'))"
_CF = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"
_SEED = "seed AS (SELECT DISTINCT node_id AS node FROM cf WHERE state = 'open' AND severity IN ('high', 'critical') AND branch = 'main' AND node_id IS NOT NULL)"
_BASE = f"{SQL}, {_ME}, {_CF}, {_SEED}"
_T = r"coalesce(regexp_matches(parse_filename(file_path), '_test\.go$|^test_.*\.py$|_test\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$'), false)"


#: Rows of (origin, node, k) cut to the cap of each origin.
_CUT = """m AS (SELECT origin, node, min(k) AS distance FROM r GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY distance, node) AS rn, count(*) OVER (PARTITION BY origin) > 200 AS truncated FROM m)
SELECT origin, node, distance, node IN (SELECT at_ FROM hub) AS is_hub, truncated FROM p WHERE rn <= 200"""


def _walk(moves: str, depth: int, hub: int | None) -> str:
    gate = f", hub AS (SELECT at_ FROM mv GROUP BY 1 HAVING count(*) > {hub})" if hub else ", hub AS (SELECT NULL AS at_ WHERE false)"
    return f"""WITH RECURSIVE {_BASE}, mv AS ({moves}){gate},
r(node, distance) AS (SELECT node, 0 FROM seed UNION SELECT mv.to_, r.distance + 1 FROM r JOIN mv ON mv.at_ = r.node WHERE r.distance < {depth} AND NOT EXISTS (SELECT 1 FROM hub WHERE hub.at_ = r.node)),
seen AS (SELECT node, min(distance) AS distance FROM r GROUP BY 1)"""


_HUBS = " SELECT node, distance, node IN (SELECT at_ FROM hub) AS is_hub FROM seen"
QUERIES = {f.__name__: f for f in (blast_radius_callers, blast_radius_both, call_chain, tests_covering, fan_in, hot_zones, entry_points, cycles, blast_radius_each, dirty_blast, call_chain_in, call_chain_both, caller_files)}
ORACLE = {
    "blast_radius_callers": _walk("SELECT dst AS at_, src AS to_ FROM me", 3, 50) + _HUBS,
    "blast_radius_both": _walk("SELECT dst AS at_, src AS to_ FROM me WHERE kind IN ('calls', 'similarto') UNION ALL SELECT src, dst FROM me WHERE kind IN ('calls', 'similarto')", 2, 20) + _HUBS,
    "call_chain": _walk("SELECT DISTINCT src AS at_, dst AS to_ FROM me WHERE kind = 'calls'", 3, None) + " SELECT DISTINCT m.at_ AS src, m.to_ AS dst, s.distance + 1 AS hop FROM seen s JOIN mv m ON m.at_ = s.node WHERE s.distance < 3",
    "tests_covering": f"""WITH RECURSIVE {_BASE}, te AS (SELECT DISTINCT node_id AS node FROM cn WHERE branch = 'main' AND kind = 'function' AND {_T} AND regexp_matches(split_part(symbol_path, '.', -1), '^(Test|Benchmark|Fuzz|Example)($|[^a-z])')),
mv AS (SELECT DISTINCT dst AS at_, src AS to_ FROM me WHERE kind = 'calls' AND src <> dst AND (dst NOT IN (SELECT node FROM te) OR dst IN (SELECT node FROM seed))),
r(node, distance) USING KEY (node) AS (SELECT node, 0 FROM seed UNION SELECT mv.to_, min(r.distance + 1) FROM r JOIN mv ON mv.at_ = r.node LEFT JOIN recurring.r o ON o.node = mv.to_ WHERE o.node IS NULL GROUP BY 1)
SELECT node, distance FROM r WHERE node IN (SELECT node FROM te)""",
    "fan_in": f"WITH {SQL}, {_ME} SELECT dst AS node_id, kind, count(*) AS inbound, count(DISTINCT src) AS sources FROM me GROUP BY 1, 2",
    "hot_zones": f"""WITH RECURSIVE {SQL}, {_ME}, mv AS (SELECT dst AS at_, src AS to_ FROM me), hub AS (SELECT at_ FROM mv GROUP BY 1 HAVING count(*) > 50),
c AS (SELECT repo_id, file_path, count(DISTINCT last_promoted_at) AS changes FROM nodes WHERE branch = 'main' AND file_path IS NOT NULL AND last_promoted_at > TIMESTAMP '2026-06-01' AND last_promoted_at <= TIMESTAMP '2026-07-01' GROUP BY 1, 2),
r(repo_id, file_path, node, k) AS (SELECT DISTINCT n.repo_id, n.file_path, n.node_id, 0 FROM cn n JOIN c ON c.repo_id = n.repo_id AND c.file_path = n.file_path WHERE n.branch = 'main'
  UNION SELECT r.repo_id, r.file_path, mv.to_, k + 1 FROM r JOIN mv ON mv.at_ = r.node WHERE k < 3 AND r.node NOT IN (SELECT at_ FROM hub)),
b AS (SELECT repo_id, file_path, least(200, count(DISTINCT node)) AS blast FROM r GROUP BY 1, 2)
SELECT repo_id, file_path, changes, blast, changes * blast AS score FROM b JOIN c USING (repo_id, file_path) ORDER BY score DESC, repo_id, file_path LIMIT 20""",
    "blast_radius_each": f"""WITH RECURSIVE {_BASE}, mv AS (SELECT dst AS at_, src AS to_ FROM me), hub AS (SELECT at_ FROM mv GROUP BY 1 HAVING count(*) > 50),
r(origin, node, k) AS (SELECT node, node, 0 FROM seed UNION SELECT r.origin, mv.to_, k + 1 FROM r JOIN mv ON mv.at_ = r.node WHERE k < 3 AND r.node NOT IN (SELECT at_ FROM hub)),
{_CUT}""",
    "dirty_blast": f"""WITH RECURSIVE {SQL}, {_ME}, mv AS (SELECT dst AS at_, src AS to_ FROM me), hub AS (SELECT at_ FROM mv GROUP BY 1 HAVING count(*) > 50),
o AS (SELECT node_id, content_hash FROM nodes WHERE branch = 'main' AND last_promoted_at <= TIMESTAMP '2026-03-01' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY last_promoted_at DESC, content_hash NULLS FIRST) = 1),
w AS (SELECT node_id, repo_id, content_hash FROM nodes WHERE branch = 'main' AND last_promoted_at > TIMESTAMP '2026-03-01' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY last_promoted_at DESC, content_hash NULLS FIRST) = 1),
r(origin, node, k) AS (SELECT w.repo_id, w.node_id, 0 FROM w LEFT JOIN o ON o.node_id = w.node_id WHERE coalesce(o.content_hash, '') = '' OR w.content_hash IS DISTINCT FROM o.content_hash
 UNION SELECT r.origin, mv.to_, k + 1 FROM r JOIN mv ON mv.at_ = r.node WHERE k < 2 AND r.node NOT IN (SELECT at_ FROM hub)),
{_CUT}""",
    "call_chain_in": f"""WITH RECURSIVE {_BASE}, bx AS (SELECT node_id FROM cn WHERE branch = 'main' AND kind IN ('package', 'file', 'module', 'chunk')), c AS (SELECT DISTINCT src, dst FROM me WHERE kind = 'calls' AND src NOT IN (SELECT node_id FROM bx)),
r(node, k) AS (SELECT node, 0 FROM seed UNION SELECT c.src, k + 1 FROM r JOIN c ON c.dst = r.node WHERE k < 3) SELECT c.src, c.dst, min(k) + 1 AS hop FROM r JOIN c ON c.dst = r.node WHERE k < 3 GROUP BY 1, 2""",
    "call_chain_both": f"""WITH RECURSIVE {_BASE}, bx AS (SELECT node_id FROM cn WHERE branch = 'main' AND kind IN ('package', 'file', 'module', 'chunk')), c AS (SELECT DISTINCT src, dst FROM me WHERE kind = 'calls'),
mv AS (SELECT src, dst, src AS at_, dst AS to_ FROM c UNION ALL SELECT src, dst, dst, src FROM c WHERE src NOT IN (SELECT node_id FROM bx)),
r(node, k) AS (SELECT node, 0 FROM seed UNION SELECT mv.to_, k + 1 FROM r JOIN mv ON mv.at_ = r.node WHERE k < 2) SELECT mv.src, mv.dst, min(k) + 1 AS hop FROM r JOIN mv ON mv.at_ = r.node WHERE k < 2 GROUP BY 1, 2""",
    "caller_files": f"""WITH {SQL}, {_ME} SELECT e.dst AS node_id, count(DISTINCT (n.repo_id, n.file_path)) AS files, count(DISTINCT (n.repo_id, n.file_path)) FILTER ({_T.replace('file_path', 'n.file_path')}) AS test_files FROM me e JOIN cn n ON n.node_id = e.src AND n.branch = 'main'
WHERE e.kind = 'calls' AND e.src <> e.dst AND n.file_path IS NOT NULL GROUP BY 1""",
    "entry_points": f"""WITH {SQL}, {_ME}, {_CF} SELECT n.node_id, n.symbol_path, n.kind, coalesce(n.exported, false) AS exported, coalesce(i.inbound, 0) AS inbound FROM cn n
LEFT JOIN (SELECT dst, count(*) AS inbound FROM me GROUP BY 1) i ON i.dst = n.node_id WHERE n.branch = 'main' AND n.kind IN ('function', 'method', 'class', 'struct', 'interface', 'type', 'command', 'route')
AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.node_id = n.node_id AND cf.state = 'open' AND cf.branch = 'main') AND NOT {_T} AND NOT coalesce(n.language = 'go' AND n.symbol_path = 'init', false)
ORDER BY inbound DESC, exported DESC, symbol_path ASC NULLS LAST, node_id LIMIT 50""",
    "cycles": f"""WITH RECURSIVE {SQL}, {_ME}, e AS (SELECT DISTINCT src, dst FROM me WHERE kind IN ('calls', 'imports', 'dependson') AND src <> dst),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT a AS node, least(a, min(b)) AS component FROM m WHERE a <> b GROUP BY 1""",
}
