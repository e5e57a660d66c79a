"""References to records that do not exist, by a skew-aware split.

References are counted by key first (partial aggregates before the shuffle).  Keys that
hold more than a fixed share of all references are few by construction; they are looked up
in the targets by broadcast, and their rows never travel.  The other rows go through one
shuffle anti-join.  Both parts are put together again.  Reports don't carry rows through the
anti-join: references are counted per key and period first, on the keys' own partitioning,
and only the counts are looked up and summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelattice.plans.identify import heavy_keys
from codelattice.plans.materialize import Workspace

HEAVY_SHARE, HEAVY_FLOOR = 2_000, 20_000


def live_nodes(nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """(node_id, branch) of node rows that no tombstone of their file covers.

    A row is dead if its file was deleted at or after its promotion; a row without a
    promotion time is dead once the file was deleted at all; one without a path is live.
    """
    last = deleted.groupBy("repo_id", "branch", "file_path").agg(F.max("deleted_at").alias("gone_at"))
    rows = nodes.select("node_id", "branch", "repo_id", "file_path", "last_promoted_at")
    rows = rows.join(last, ["repo_id", "branch", "file_path"], "left")
    return rows.where(F.col("gone_at").isNull() | (F.col("last_promoted_at") > F.col("gone_at"))).select("node_id", "branch")


def orphan_rows(refs: DataFrame, keys: list[str], targets: DataFrame, n_refs: int | None = None, share: int = HEAVY_SHARE, floor: int = HEAVY_FLOOR) -> DataFrame:
    """Rows of ``refs`` whose ``keys`` no row of ``targets`` has.

    A row with a null in a key names nothing that could be there: it is an orphan.
    Repeated rows stay; ``targets`` may repeat; extra columns of ``refs`` are kept.  With
    empty ``targets`` every row is an orphan.  ``n_refs`` saves a count where it is known.
    """
    targets = targets.select(*keys)
    n = refs.count() if n_refs is None else n_refs
    if n <= floor:  # no key can be heavy
        return refs.join(targets, keys, "left_anti")
    named = refs.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    heavy = F.broadcast(heavy_keys(named, keys, n, share, floor).drop("heavy_n"))
    # the heavy keys that are there: the targets are filtered where they lie
    found = F.broadcast(targets.join(heavy, keys, "left_semi").distinct())
    light = refs.join(heavy, keys, "left_anti").join(targets, keys, "left_anti")
    return refs.join(heavy, keys, "left_semi").join(found, keys, "left_anti").unionByName(light)


def orphan_totals(refs: DataFrame, keys: list[str], targets: DataFrame, table: str, share: int = HEAVY_SHARE, floor: int = HEAVY_FLOOR) -> DataFrame:
    """``(ref_table, period, orphans)``: distinct references per period whose ``keys`` no row of ``targets`` has.

    ``refs`` (keys, ref_id, branch, period).  References are distinct by id, branch, period and
    keys.  Heavy keys are looked up by broadcast, which leaves at most ``share`` of them to
    count; the light ones are laid out by key once, so that counting per key and period
    and the anti-join share one shuffle.
    """
    work = Workspace(refs.sparkSession, "totals")
    id_of, targets = list(dict.fromkeys(["ref_id", "branch", "period", *keys])), targets.select(*keys)
    refs = work.write(refs.select(*id_of), "refs")
    n = refs.count()
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    parts, light = [refs.where(null).select(*id_of).distinct()], refs.where(f"NOT ({null})")
    if n > floor:
        heavy = work.write(heavy_keys(light, keys, n, share, floor).select(*keys), "heavy")
        few = F.broadcast(heavy)
        lost = work.write(heavy.join(targets.join(few, keys, "left_semi").distinct(), keys, "left_anti"), "lost")
        parts.append(light.join(F.broadcast(lost), keys, "left_semi").select(*id_of).distinct())
        light = light.join(few, keys, "left_anti")
    counted = light.repartition(*keys).groupBy(*id_of).agg(F.lit(1).alias("one")).groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n")).join(targets, keys, "left_anti").select("period", "n")
    for part in parts:
        counted = counted.unionByName(part.groupBy("period").agg(F.count(F.lit(1)).alias("n")))
    return counted.groupBy("period").agg(F.sum("n").alias("orphans")).select(F.lit(table).alias("ref_table"), "period", "orphans")


def month(ts) -> F.Column:
    return F.date_format(ts, "yyyy-MM")


def edge_refs(edges: DataFrame) -> DataFrame:
    """What edges refer to: a node on their branch, in the month of their promotion."""
    return edges.select("edge_id", F.col("dst_node_id").alias("node_id"), "branch", month(F.col("last_promoted_at")).alias("period"))


def orphan_edges(edges: DataFrame, nodes: DataFrame, deleted: DataFrame, **skew) -> DataFrame:
    """Edge rows whose (dst_node_id, branch) has no live node row, with period the month of promotion."""
    lost = orphan_rows(edge_refs(edges), ["node_id", "branch"], live_nodes(nodes, deleted), **skew)
    return lost.select(F.lit("edges").alias("ref_table"), F.col("edge_id").alias("ref_id"), F.coalesce("branch", F.lit("")).alias("branch"), "period")


def _key(scope: str, column: str) -> F.Column:
    """Targets were typed by hand: blanks around them, letter case of ids and a leading ./ don't count."""
    c = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    return F.regexp_replace(c, r"^(\./)+", "") if scope == "file" else F.lower(c)


def suppression_refs(suppressions: DataFrame, findings: DataFrame, nodes: DataFrame, deleted: DataFrame, files: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What suppressions refer to by (scope, target), and all targets there are, each scope's from its own table."""
    scope = F.lower(F.trim("scope"))
    where = {
        "finding": (findings, "finding_id"),
        "symbol": (live_nodes(nodes, deleted), "node_id"),
        "file": (files, "file_path"),
        "repo": (repos, "repo_id"),
    }
    target = F.when(scope == "file", _key("file", "target")).otherwise(_key("id", "target"))
    refs = suppressions.select("suppression_id", scope.alias("scope"), target.alias("target"), F.coalesce("branch", F.lit("")).alias("branch"), month(F.col("created_at")).alias("period"))
    there = None
    for name, (df, column) in where.items():
        one = df.select(F.lit(name).alias("scope"), _key(name, column).alias("target")).distinct()
        there = one if there is None else there.unionByName(one)
    return refs, there


def orphan_suppressions(suppressions: DataFrame, findings: DataFrame, nodes: DataFrame, deleted: DataFrame, files: DataFrame, repos: DataFrame, **skew) -> DataFrame:
    """Suppressions whose target is nowhere, each scope against its own table, on any branch.

    An unknown or null scope and a null target name nothing: orphans.
    """
    refs, there = suppression_refs(suppressions, findings, nodes, deleted, files, repos)
    lost = orphan_rows(refs, ["scope", "target"], there, **skew)
    return lost.select(F.lit("suppressions").alias("ref_table"), F.col("suppression_id").alias("ref_id"), F.coalesce("branch", F.lit("")).alias("branch"), "period")


def orphan_report(edges: DataFrame, suppressions: DataFrame, findings: DataFrame, nodes: DataFrame, deleted: DataFrame, files: DataFrame, repos: DataFrame, **skew) -> DataFrame:
    """Orphan references per table and period: ``(ref_table, period, orphans)``; a null period is one of its own.

    Repeated references count once; an edge id that names two missing nodes in one month counts twice.
    """
    e = edge_refs(edges).withColumnRenamed("edge_id", "ref_id")
    s, there = suppression_refs(suppressions, findings, nodes, deleted, files, repos)
    a = orphan_totals(e, ["node_id", "branch"], live_nodes(nodes, deleted), "edges", **skew)
    return a.unionByName(orphan_totals(s.withColumnRenamed("suppression_id", "ref_id"), ["scope", "target"], there, "suppressions", **skew))
