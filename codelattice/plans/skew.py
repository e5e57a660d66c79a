"""Joins to a side without repeated keys, where few keys may hold most of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelattice.plans.identify import heavy_keys
from codelattice.plans.materialize import Workspace

#: A key is heavy with more than max(HEAVY_FLOOR, rows / HEAVY_SHARE) rows; at most HEAVY_SHARE keys can be.
HEAVY_SHARE, HEAVY_FLOOR = 2_000, 100_000


def split_join(rows: DataFrame, side: DataFrame, on: str | list[str], n_rows: int, work: Workspace, how: str = "inner", share: int = HEAVY_SHARE, floor: int = HEAVY_FLOOR) -> DataFrame:
    """``rows`` joined to ``side`` (one row a key) by ``on``; rows of heavy keys never travel.

    ``rows`` is read several times: a written table.  Heavy keys are counted by partial
    aggregates; their rows of ``side``, at most ``share`` of them, go by broadcast.  A null
    in a key matches nothing and is kept by a left join.
    """
    if n_rows <= max(floor, n_rows // share):  # no key can be heavy
        return rows.join(side, on, how)
    on = [on] if isinstance(on, str) else on
    heavy = work.write(heavy_keys(rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on)), on, n_rows, share, floor).select(*on), "heavy")
    if heavy.isEmpty():
        return rows.join(side, on, how)
    few = F.broadcast(heavy)
    hot = rows.join(few, on, "left_semi").join(F.broadcast(side.join(few, on, "left_semi")), on, how)
    return rows.join(few, on, "left_anti").join(side, on, how).unionByName(hot)
