"""Parent-child links to full hierarchies: peeled leaves, Euler tours, list ranking.

1. *Peeling.*  Leaves are removed until none is left; what stays are the rings of parents.
   Rounds run as joins (each also splices out half-random single-child nodes where leaves
   alone remove little, so long chains need few rounds, and takes off rings spliced down to
   one node) until the rest fits the fixed bound ``FINISH``, which one task then peels in
   memory.
2. *Tours.*  Links into ring nodes are cut, so every ring node tops a tree of its own, and
   each tree becomes a linked list that enters and leaves every node once.  The stretch of
   the list that lies among the children of one parent is contracted on the spot, so only
   two list elements for each inner node go on.
3. *List ranking.*  Random-mate contraction removes a quarter of the elements a round, as a
   join; lists of one element are ranked and go, however many there are; below ``FINISH``
   one task ranks the rest; the removed ones are put back in reverse.
   Total work is linear, rounds are logarithmic, however deep the trees.

Positions count from the end of the tour (the last step is 0), so ``entry`` < ``exit`` and
a node's descendants are those with an entry between the two, under the same root.

4. *Sweep.*  Paths and descendants come from the intervals: nodes are laid out by (root,
   entry) in blocks of about ``SWEEP_ROWS``, however large a tree is; each block is also
   given the nodes whose interval is open where it begins.  Read in order, the ancestors of
   a node are then the last node before it on each level above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codelattice.plans.identify import number_ids
from codelattice.plans.materialize import Workspace
from codelattice.plans.skew import split_join

#: Rows that one task finishes in memory.
FINISH = 50_000
#: Nodes of a block of the sweep, and elements of paths that it holds at once.
SWEEP_ROWS, SWEEP_ELEMENTS = 250_000, 1_000_000
#: Children of one parent beyond which its children are split over several blocks.
WIDE = 100_000
CYCLE, CYCLE_DEPTH = "(cycle)", -1
#: ``slot`` of a list element (node, slot): 0 and up enters the node's n-th block of children.
LEAVE, END, END_RING = -1, -2, -3

_HEADS = "node long, slot int, next_node long, next_slot int, cnt long, total long"


def _peel_in_memory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (child, parent) rows of a bounded remainder -> the children on rings."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    child, parent = (t.column(c).to_numpy() for c in ("child", "parent"))
    nodes, index = np.unique(np.concatenate([child, parent]), return_inverse=True)
    c, p = index[: len(child)], index[len(child) :]
    up = np.full(len(nodes), -1)
    up[c] = p
    waiting = np.bincount(p, minlength=len(nodes))
    layer = np.flatnonzero(waiting == 0)
    gone = np.zeros(len(nodes), bool)
    while len(layer):
        gone[layer] = True
        above = up[layer]
        above = above[above >= 0]
        np.subtract.at(waiting, above, 1)
        above = np.unique(above)
        layer = above[(waiting[above] == 0) & ~gone[above]]
    ring = nodes[~gone & (up >= 0)]
    yield pa.RecordBatch.from_arrays([pa.array(ring, pa.int64())], ["node"])


def _ring_nodes(links: DataFrame, n: int, work: Workspace, finish: int) -> DataFrame:
    """Nodes on rings of parents, by peeling leaves."""
    spliced, loops, rest, turn = [], [], links, 0
    while n > finish:
        inner = rest.select(F.col("parent").alias("child")).distinct()
        kept = work.write(rest.join(inner, "child", "left_semi"), "peeled")
        before, n = n, kept.count()
        if rest is not links:
            work.drop(rest)
        rest = kept
        if n > finish and n > 0.7 * before:  # chains: take out single children's parents too
            turn += 1
            coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))  # noqa: B023,E731
            loops.append(work.write(rest.where("child = parent").select(F.col("child").alias("node")), "loops"))  # no round takes these off
            open_ = rest.where("child <> parent")
            single = open_.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.min("child").alias("only")).where("k = 1")
            mid = single.join(open_.select(F.col("child").alias("parent"), F.col("parent").alias("above")), "parent")
            mid = mid.where((coin(F.col("parent")) == 0) & (coin(F.col("only")) == 1)).select(F.col("parent").alias("out"), F.col("only").alias("child"), "above")
            mid = work.write(mid, "spliced")
            spliced.append(mid)
            new = open_.join(mid.select(F.col("out").alias("child")), "child", "left_anti").join(mid.select("child", "above"), "child", "left")
            kept = work.write(new.select("child", F.coalesce("above", "parent").alias("parent")), "shortened")
            work.drop(rest)
            rest, n = kept, kept.count()
    ring = rest.select("child", "parent").coalesce(1).mapInArrow(_peel_in_memory, "node long")
    for found in loops:
        ring = ring.unionByName(found)
    ring = work.write(ring, "ring")
    for mid in reversed(spliced):  # a spliced node lies on a ring if its only child does
        ring = work.write(ring.unionByName(mid.join(ring.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("out").alias("node"))), "ring")
    return ring


def _tour_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, whole blocks of siblings -> list elements contracted within each block.

    ``what`` 0: a list element that another block points to; 1: the step into a child.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    parent, block, child, inner, nxt, ring = (t.column(c).to_numpy() for c in ("parent", "block", "child", "inner", "next_block", "ring_parent"))
    order = np.lexsort((child, block, parent))
    parent, block, child, inner, nxt, ring = (x[order] for x in (parent, block, child, inner, nxt, ring))
    n = len(child)
    first = np.ones(n, bool)
    first[1:] = (parent[1:] != parent[:-1]) | (block[1:] != block[:-1])
    start = np.flatnonzero(first)
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))  # of each row's block
    # the first inner row at or after each row, n if there is none
    at = np.where(inner, np.arange(n), n)
    following = np.append(np.minimum.accumulate(at[::-1])[::-1], n)

    def onward(j, last_row, base_cnt, base_sum):
        """A walk that stands before row j of the block that holds ``last_row``."""
        stop = end[last_row]
        hit = following[j]
        inside = hit < stop
        safe = np.where(inside, hit, 0)
        cnt = base_cnt + 2 * (np.where(inside, hit, stop) - j) + inside
        to_node = np.where(inside, child[safe], parent[last_row])
        leave = np.where(ring[last_row], END_RING, LEAVE)
        to_slot = np.where(inside, 0, np.where(nxt[last_row] >= 0, nxt[last_row], leave))
        return to_node, to_slot, cnt, base_sum + inside

    i = np.flatnonzero(inner)
    leaf = np.flatnonzero(~inner)
    parts = [
        (0, parent[start], block[start], start, *onward(start, start, 0, 0)),
        (0, child[i], np.full(len(i), LEAVE), i, *onward(i + 1, i, 1, -1)),
        (1, child[i], np.zeros(len(i), int), i, child[i], np.zeros(len(i), int), np.ones(len(i), int), np.ones(len(i), int)),
        (1, child[leaf], np.zeros(len(leaf), int), leaf, *onward(leaf + 1, leaf, 2, 0)),
    ]
    for what, node, slot, row, to_node, to_slot, cnt, total in parts:
        if len(node):
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            data = (np.full(len(node), what), node, slot, parent[row], to_node, to_slot, cnt, total, inner[row] if what else np.zeros(len(node), bool))
            out = [pa.array(x, k) for x, k in zip(data, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(out, ["what", "node", "slot", "parent", "next_node", "next_slot", "cnt", "total", "inner"])


def _rank_in_memory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded list remainder -> for each element the steps and the level to the end, and where it ends."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    node, slot, to_node, to_slot, cnt, total = (t.column(c).to_numpy() for c in ("node", "slot", "next_node", "next_slot", "cnt", "total"))
    key = np.empty(2 * len(node), dtype=[("n", np.int64), ("s", np.int32)])
    key["n"], key["s"] = np.concatenate([node, to_node]), np.concatenate([slot, to_slot])
    keys, index = np.unique(key, return_inverse=True)
    m = len(keys)
    succ, c, s = np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
    own = index[: len(node)]
    succ[own], c[own], s[own] = index[len(node) :], cnt, total
    while True:
        after = succ[succ]
        if (after == succ).all():
            break
        c, s, succ = c + c[succ], s + s[succ], after
    tail = keys[succ[own]]
    out = [pa.array(x, k) for x, k in ((node, pa.int64()), (slot, pa.int32()), (tail["n"], pa.int64()), (tail["s"], pa.int32()), (c[own], pa.int64()), (s[own], pa.int64()))]
    yield pa.RecordBatch.from_arrays(out, ["node", "slot", "tail", "tail_slot", "cnt", "total"])


def _rank(heads: DataFrame, n: int, work: Workspace, finish: int) -> DataFrame:
    """List ranking by random-mate contraction: (node, slot, tail, tail_slot, cnt, total) of every element."""
    removed, done, turn = [], [], 0
    if n > finish:  # lists of one element never shrink: each list's first element and those that lead to an end are marked
        own, onward = heads.select("node", "slot"), heads.select(F.col("next_node").alias("node"), F.col("next_slot").alias("slot")).distinct()
        there = own.toDF("next_node", "next_slot").withColumn("more", F.lit(True))
        marked = heads.join(onward.withColumn("later", F.lit(True)), ["node", "slot"], "left").join(there, ["next_node", "next_slot"], "left")
        heads = work.write(marked.select(*heads.columns, F.col("later").isNull().alias("first"), F.col("more").isNull().alias("ended")), "marked")
    while n > finish:
        turn += 1
        coin = lambda a, b: F.pmod(F.xxhash64(a, b, F.lit(turn)), F.lit(2))  # noqa: B023,E731
        done.append(work.write(heads.where("first AND ended").select("node", "slot", F.col("next_node").alias("tail"), F.col("next_slot").alias("tail_slot"), "cnt", "total"), "done"))
        live = heads.where("NOT (first AND ended)")
        out = live.where(coin("node", "slot") == 0).select(F.col("node").alias("next_node"), F.col("slot").alias("next_slot"), F.col("next_node").alias("n2"), F.col("next_slot").alias("s2"), F.col("cnt").alias("c2"), F.col("total").alias("t2"), F.col("ended").alias("e2"))
        takes = ~F.col("ended") & (coin("next_node", "next_slot") == 0)
        takers = live.where((coin("node", "slot") == 1) & takes)
        taken = takers.join(out, ["next_node", "next_slot"]).select("node", "slot", F.col("n2").alias("next_node"), F.col("s2").alias("next_slot"), (F.col("cnt") + F.col("c2")).alias("cnt"), (F.col("total") + F.col("t2")).alias("total"), "first", F.col("e2").alias("ended"))
        gone = takers.select(F.col("next_node").alias("node"), F.col("next_slot").alias("slot"))
        others = live.where((coin("node", "slot") == 1) & ~takes)
        zeros = live.where(coin("node", "slot") == 0)
        removed.append(work.write(zeros.join(gone, ["node", "slot"], "left_semi").select("node", "slot", "next_node", "next_slot", "cnt", "total"), "removed"))
        before_heads, heads = heads, work.write(taken.unionByName(others).unionByName(zeros.join(gone, ["node", "slot"], "left_anti")), "heads")
        work.drop(before_heads)
        before, n = n, heads.count()
        if turn > 40 + 4 * int(np.log2(before + 2)):
            raise RuntimeError("list ranking doesn't shrink: the links are no tree")
    ranked = heads.select("node", "slot", "next_node", "next_slot", "cnt", "total").coalesce(1).mapInArrow(_rank_in_memory, "node long, slot int, tail long, tail_slot int, cnt long, total long")
    if removed:
        ranked = work.write(ranked, "ranked")
    for part in reversed(removed):
        ranked = work.write(ranked.unionByName(_resolve(part, ranked).select("node", "slot", "tail", "tail_slot", "cnt", "total")), "ranked")
    for part in done:  # nothing leads to a list's first element
        ranked = ranked.unionByName(part)
    return ranked


def _resolve(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rows that point to (next_node, next_slot) -> the same with the values up to the end added."""
    seen = ranked.select(F.col("node").alias("next_node"), F.col("slot").alias("next_slot"), F.col("tail").alias("t_"), F.col("tail_slot").alias("s_"), F.col("cnt").alias("c_"), F.col("total").alias("l_"))
    j = rows.join(seen, ["next_node", "next_slot"], "left")
    keep = [c for c in rows.columns if c not in ("next_node", "next_slot", "cnt", "total")]
    return j.select(*keep, F.coalesce("t_", "next_node").alias("tail"), F.coalesce("s_", "next_slot").alias("tail_slot"), (F.col("cnt") + F.coalesce("c_", F.lit(0))).alias("cnt"), (F.col("total") + F.coalesce("l_", F.lit(0))).alias("total"))


def hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", finish: int = FINISH, wide: int = WIDE, intervals: bool = True) -> DataFrame:
    """Root, depth and tour interval of each node that is an end of a link.

    Returns ``(node_id, parent_id, root_id, depth)`` and, with ``intervals``, ``(entry, exit)``.
    A root has depth 0 and no parent.  A node on a ring of parents (one that is its own
    parent included) or anywhere below one has ``root_id`` ``(cycle)``, depth -1 and no
    interval.

    Rows with a null end are left out; repeated rows count once; of several parents of one
    node the smallest id counts; further columns are not read; an empty input gives an
    empty result.
    """
    spark = links.sparkSession
    work = Workspace(spark, "hierarchy")
    raw = links.select(F.col(child).cast("string").alias("c"), F.col(parent).cast("string").alias("p")).where("c IS NOT NULL AND p IS NOT NULL")
    raw = work.write(raw.groupBy("c").agg(F.min("p").alias("p")), "raw")
    ids = number_ids(raw.select(F.col("c").alias("id")).unionByName(raw.select(F.col("p").alias("id"))), "id", work, "ids")
    as_child, as_parent = ids.select(F.col("id").alias("c"), F.col("nr").alias("child")), ids.select(F.col("id").alias("p"), F.col("nr").alias("parent"))
    half = work.write(raw.join(as_child, "c").select("child", "p"), "children")
    work.drop(raw)
    n = half.count()
    coded = work.write(split_join(half, as_parent, "p", n, work).select("child", "parent"), "links")
    work.drop(half)

    ring = _ring_nodes(coded, n, work, finish)
    n_ring = ring.count()
    few_rings = n_ring <= 200_000
    ring_side = F.broadcast(ring) if few_rings else ring
    ring_parents = ring.select(F.col("node").alias("parent"), F.lit(True).alias("r_"))
    # the tree links: a ring node's own link is cut; a link whose parent lies on a ring leads to a ring end
    tree = coded.join(ring_side.select(F.col("node").alias("child")), "child", "left_anti")
    parents = tree.select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
    tree = tree.join(parents, "child", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    if few_rings:
        tree = tree.join(F.broadcast(ring_parents), "parent", "left")
    else:
        tree = split_join(work.write(tree, "tree"), ring_parents, "parent", n, work, "left")
    tree = tree.select("parent", "child", "inner", F.coalesce("r_", F.lit(False)).alias("ring_parent"))
    tree = _blocks(tree, coded, n, wide, work)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), n // 500_000)
    elements = work.write(
        tree.repartition(spread, "parent", "block").mapInArrow(_tour_blocks, "what int, node long, slot int, parent long, next_node long, next_slot int, cnt long, total long, inner boolean"),
        "elements",
    )
    heads = elements.where("what = 0").select("node", "slot", "next_node", "next_slot", "cnt", "total")
    n_heads = heads.count()
    ranked = work.write(_rank(heads, n_heads, work, finish), "values")

    # an END is named by its root; only the list elements learn the names, once for each root
    tops = ids.select(F.col("nr").alias("tail"), F.col("id").alias("root_id"))
    root_rows = ranked.where((F.col("slot") == 0) & (F.col("node") == F.col("tail")))
    names = work.write(root_rows.select("tail").distinct().join(tops, "tail").select("tail", "root_id"), "roots")
    few_roots = names.count() <= 50_000
    named = ranked.join(F.broadcast(names), "tail", "left") if few_roots else split_join(ranked, names, "tail", n_heads, work, "left")
    into = elements.where("what = 1").select("node", "parent", "next_node", "next_slot", "cnt", "total", "inner")
    seen = named.select(F.col("node").alias("next_node"), F.col("slot").alias("next_slot"), F.col("tail").alias("t_"), F.col("tail_slot").alias("s_"), F.col("cnt").alias("c_"), F.col("total").alias("l_"), F.col("root_id").alias("r_"))
    joined = into.join(seen, ["next_node", "next_slot"], "left")
    # a step that leads straight to an end (a last leaf under a root) has no element to ask: its parent is the root
    own = names.select(F.col("tail").alias("parent"), F.col("root_id").alias("own_"))
    joined = joined.join(F.broadcast(own), "parent", "left") if few_roots else split_join(work.write(joined, "steps"), own, "parent", n, work, "left")
    slot = F.coalesce("s_", "next_slot")
    root = F.when(slot == END_RING, F.lit(CYCLE)).otherwise(F.coalesce("r_", "own_"))
    entry = F.col("cnt") + F.coalesce("c_", F.lit(0))
    # levels still to go down from here to the root's end, this step into the node included
    depth = F.lit(1) - (F.col("total") + F.coalesce("l_", F.lit(0)))
    below = joined.select("node", "parent", "inner", root.alias("root_id"), depth.cast("int").alias("depth"), (-entry).alias("entry"))
    if intervals:
        leaves = ranked.where(F.col("slot") == LEAVE).select("node", (-F.col("cnt")).alias("exit_"))
        below = below.join(leaves, "node", "left").withColumn("exit", F.coalesce("exit_", F.col("entry") + 1)).drop("exit_")
    top = root_rows.where(F.col("tail_slot") == LEAVE).select("node", F.lit(None).cast("long").alias("parent"), F.lit(True).alias("inner"), F.lit(None).cast("string").alias("root_id"), F.lit(0).alias("depth"), (-F.col("cnt") - 1).alias("entry"))
    looped = ring.join(coded.select(F.col("child").alias("node"), "parent"), "node").select("node", "parent", F.lit(True).alias("inner"), F.lit(CYCLE).alias("root_id"), F.lit(CYCLE_DEPTH).alias("depth"), F.lit(None).cast("long").alias("entry"))
    if intervals:
        top, looped = top.withColumn("exit", F.lit(0).cast("long")), looped.withColumn("exit", F.lit(None).cast("long"))
    out = below.unionByName(top).unionByName(looped)
    ring_root = F.col("root_id") == CYCLE
    out = out.join(ids.select(F.col("nr").alias("node"), F.col("id").alias("node_id")), "node")
    columns = ["node_id", F.coalesce("root_id", "node_id").alias("root_id"), F.when(ring_root, F.lit(CYCLE_DEPTH)).otherwise(F.col("depth")).alias("depth")]
    if intervals:
        out = split_join(work.write(out, "nodes"), ids.select(F.col("nr").alias("parent"), F.col("id").alias("parent_id")), "parent", n, work, "left")
        columns += ["parent_id", *(F.when(~F.coalesce(ring_root, F.lit(False)), F.col(c)).alias(c) for c in ("entry", "exit"))]
    return out.select(*columns)


def _blocks(tree: DataFrame, coded: DataFrame, n: int, wide: int, work: Workspace) -> DataFrame:
    """Split the children of very wide parents into blocks, each of which knows the next one.

    At most n / wide parents are that wide, with at most 2 n / wide blocks; wide grows with n.
    """
    wide = max(wide, n // 10_000)
    if n <= wide:
        return tree.withColumn("block", F.lit(0)).withColumn("next_block", F.lit(-1))
    many = coded.groupBy("parent").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > wide).select("parent", F.ceil(F.col("k") / wide).cast("int").alias("blocks"))
    tree = tree.join(F.broadcast(many), "parent", "left").withColumn("part", F.pmod(F.xxhash64("child"), F.coalesce("blocks", F.lit(1))).cast("int"))
    tree = work.write(tree.withColumn("wide", F.col("blocks").isNotNull()).drop("blocks"), "blocks")
    # blocks that exist, numbered without gaps
    there = tree.where("wide").groupBy("parent", "part").agg(F.lit(1).alias("x"))
    w = Window.partitionBy("parent").orderBy("part")
    there = there.select("parent", "part", (F.row_number().over(w) - 1).alias("b_"), F.lead(F.lit(1)).over(w).alias("more"))
    tree = tree.join(F.broadcast(there), ["parent", "part"], "left")
    block = F.coalesce("b_", F.lit(0))
    return tree.select("parent", "child", "inner", "ring_parent", block.alias("block"), F.when(F.col("more").isNotNull(), block + 1).otherwise(F.lit(-1)).alias("next_block"))


def _open_at(starts: dict[str, tuple[np.ndarray, np.ndarray]]):
    """Rows of the layout -> the same, and again for each later block that begins within the node's interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("open", pa.array(np.zeros(b.num_rows, bool)))
            roots = b.column("root_id")
            for root in pa.compute.unique(roots).to_pylist():
                if root not in starts:
                    continue
                at, blocks = starts[root]
                row = np.flatnonzero(pa.compute.equal(roots, root).to_numpy(zero_copy_only=False))
                first = np.searchsorted(at, b.column("entry").to_numpy()[row], side="right")
                reps = np.searchsorted(at, b.column("exit").to_numpy()[row], side="left") - first
                again = np.repeat(row, np.maximum(reps, 0))
                if len(again):
                    nth = np.repeat(first, np.maximum(reps, 0)) + np.arange(len(again)) - np.repeat(np.cumsum(np.maximum(reps, 0)) - np.maximum(reps, 0), np.maximum(reps, 0))
                    t = b.take(pa.array(again))
                    out = [pa.array(blocks[nth], pa.int32()) if name == "block" else t.column(name) for name in b.schema.names]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(np.ones(len(again), bool))], [*b.schema.names, "open"])

    return run


def _sweep(emit, elements: int):
    """Rows in the order of (block, root, entry) -> what ``emit(t, rows, depth, above)`` makes of them.

    ``above`` holds for each of ``rows`` the places in ``t`` of its ancestors and itself, root
    first, one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for whole in batches:
            size = np.cumsum(whole.column("depth").to_numpy().astype(np.int64) + 1)
            at = 0
            while at < whole.num_rows:
                base = size[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(size, base + elements, side="right")))
                t = pa.Table.from_batches([whole.slice(at, end - at)])
                if carry is not None:
                    t = pa.concat_tables([carry, t])
                t, kept, at = t.combine_chunks(), 0 if carry is None else carry.num_rows, end
                depth = t.column("depth").to_numpy()
                start = np.append(0, np.cumsum(depth.astype(np.int64) + 1))
                above = np.zeros(start[-1], np.int64)
                live = np.arange(len(depth))
                for level in range(int(depth.max(initial=-1)) + 1):
                    live = live[depth[live] >= level]
                    here = np.where(depth[live] == level, live, -1)
                    above[start[live] + level] = np.maximum.accumulate(here)
                rows = np.flatnonzero(~t.column("open").to_numpy() & (np.arange(len(depth)) >= kept))
                if len(rows):
                    yield from emit(t, rows, depth[rows], above[np.repeat(start[rows], depth[rows] + 1) + _within(depth[rows] + 1)])
                carry = t.take(pa.array(above[start[-2] : start[-1]]))
                carry = carry.set_column(carry.schema.get_field_index("open"), "open", pa.array(np.ones(carry.num_rows, bool)))

    return run


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _swept(h: DataFrame, emit, schema: str, name: str, block_rows: int, elements: int) -> DataFrame:
    """``emit`` over all nodes outside the rings, by their intervals."""
    spark = h.sparkSession
    work = Workspace(spark, name)
    rows = work.write(h.where("depth >= 0").select("root_id", "entry", "exit", "node_id", "depth"), "intervals")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // block_rows))
    laid = work.write(rows.repartitionByRange(blocks, "root_id", "entry").withColumn("block", F.spark_partition_id()), "layout")
    work.drop(rows)
    firsts = laid.groupBy("block").agg(F.min(F.struct("root_id", "entry", "depth")).alias("f")).collect()  # a row a block
    starts: dict[str, list[tuple[int, int]]] = {}
    for r in firsts:
        if r["f"]["depth"] > 0:
            starts.setdefault(r["f"]["root_id"], []).append((r["f"]["entry"], r["block"]))
    within = {root: tuple(np.array(x) for x in zip(*sorted(found), strict=True)) for root, found in starts.items()}
    fields = "root_id string, entry long, exit long, node_id string, depth int, block int, open boolean"
    both = laid.mapInArrow(_open_at(within), fields)
    ordered = both.repartitionByRange(blocks, "block").sortWithinPartitions("block", "root_id", "entry")
    return ordered.mapInArrow(_sweep(emit, elements), schema)


def paths(h: DataFrame, block_rows: int = SWEEP_ROWS, elements: int = SWEEP_ELEMENTS) -> DataFrame:
    """``(node_id, path)``: ids from the root down to each node of a ``hierarchy`` with intervals.

    Nodes on or below rings have no path and give no row.
    """

    def emit(t, rows, depth, above):
        offsets = pa.array(np.append(0, np.cumsum(depth + 1)), pa.int32())
        names = t.column("node_id").combine_chunks()
        lists = pa.ListArray.from_arrays(offsets, names.take(pa.array(above)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), lists], ["node_id", "path"])

    return _swept(h, emit, "node_id string, path array<string>", "paths", block_rows, elements)


def descendants(h: DataFrame, block_rows: int = SWEEP_ROWS, elements: int = SWEEP_ELEMENTS) -> DataFrame:
    """``(node_id, descendant_id, levels, entry, exit)``: every node below each node, a row for each pair that is there, with the upper node's interval."""

    def emit(t, rows, depth, above):
        within = _within(depth + 1)
        own = np.repeat(rows, depth + 1)
        deep = np.repeat(depth, depth + 1)
        upper = within < deep
        a, d, n = above[upper], own[upper], (deep - within)[upper]
        if len(a):
            up = t.take(pa.array(a))
            columns = [up.column("node_id"), t.column("node_id").take(pa.array(d)), pa.chunked_array([pa.array(n, pa.int32())]), up.column("entry"), up.column("exit")]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], ["node_id", "descendant_id", "levels", "entry", "exit"])

    return _swept(h, emit, "node_id string, descendant_id string, levels int, entry long, exit long", "descendants", block_rows, elements)
