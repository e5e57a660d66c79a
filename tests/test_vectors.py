import numpy as np

from codelattice.operators.vectors import exact_search


def test_ties_are_cut_by_id_however_many(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1_500, 8)), 3)
    x[rng.choice(1_500, 500, replace=False)] = x[0]  # a third are copies of one vector
    signs = np.array([[1 if i >> b & 1 else -1 for b in range(8)] for i in range(60)], float)  # sixty different ones at one distance from zero
    x[np.arange(20, 1_220, 20)] = signs * 0.5
    ids = rng.permutation(1_500).tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    asked = [(9_000, x[0].tolist()), (9_001, [0.0] * 8), (ids[0], x[0].tolist()), *rows[1:6]]
    schema = "vec_id long, embedding array<double>"
    # some rows stand twice
    vectors = spark.createDataFrame([*rows, *rows[:300]], schema)
    due = set()
    for qi, q in asked:
        score = np.round(1 / (1 + ((x - np.array(q)) ** 2).sum(axis=1)), 9)
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != qi)[:5]
        due |= {(qi, i, r + 1) for r, (_, i) in enumerate(best)}
    for parts in (1, 3):
        got = {(r.query_id, r.vec_id, r["rank"]) for r in exact_search(vectors.repartition(parts), spark.createDataFrame(asked, schema), 5).collect()}
        assert got == due
