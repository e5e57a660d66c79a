import collections
import random

from codelattice.llm.packing import Places, fill_report, pack, plan

TOK = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_plan_keeps_every_item():
    rnd = random.Random(2)
    for cap in (1, 7, 30, 2048):
        for _ in range(40):
            counts = collections.Counter(rnd.randint(1, cap) for _ in range(rnd.randrange(300)))
            boxes, got = plan(counts, cap), collections.Counter()
            for n, sizes in boxes:
                assert n > 0 and 0 < sum(sizes) <= cap and sum(3 * s > cap for s in sizes) <= 2
                for s in sizes:
                    got[s] += n
            assert got == counts
            places, fill = Places(boxes), collections.Counter()
            for s, k in counts.items():
                for box in places.of(*(__import__("numpy").array(x) for x in ([s] * k, range(k)))):
                    fill[int(box)] += s
            assert all(v <= cap for v in fill.values()) and len(fill) == sum(n for n, _ in boxes)


def test_plan_fills_well():
    rnd = random.Random(4)
    counts = collections.Counter(min(2048, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    assert sum(s * n for s, n in counts.items()) / 2048 / sum(n for n, _ in plan(counts, 2048)) > 0.97


def test_pack(spark):
    rows = [(i, "word " * (i * 7 % 90 + 1), "x") for i in range(300)] + [(900, "alpha beta " * 4000, ""), (901, "", ""), (902, None, ""), (903, "q" * 30_000, ""), (5, "word", "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = pack(df, capacity=100, tokenizer=TOK).collect()
    fill, pieces = collections.Counter(), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        if r.container_id is None:
            assert r.tokens == 0 and r.doc_id in (901, 902)
        else:
            fill[r.container_id] += r.tokens
    assert len(pieces) == 304 and max(fill.values()) <= 100 and set(fill) == set(range(len(fill)))
    for rows in pieces.values():
        rows.sort(key=lambda r: r.piece)
        assert [r.first_token for r in rows] == [100 * i for i in range(len(rows))]
        assert all(r.tokens == 100 for r in rows[:-1])  # divided only where longer than a container
    report = fill_report(pack(df, capacity=100, tokenizer=TOK), df, 100).first()
    assert (report.documents, report.lost_documents, report.over_capacity, report.needlessly_divided, report.gapped) == (304, 0, 0, 0, 0)
    assert report.containers == len(fill) and report.tokens == sum(fill.values()) and 0.9 < report.fill <= 1
    bad = spark.createDataFrame([(1, 0, 0, 80, 0), (2, 0, 0, 30, 0), (2, 1, 40, 10, 1)], "doc_id long, piece int, first_token long, tokens long, container_id long")
    report = fill_report(bad, df, 100).first()
    assert (report.over_capacity, report.needlessly_divided, report.gapped, report.lost_documents) == (1, 1, 1, 302)
    none = fill_report(bad.limit(0), df.limit(0), 100).first()
    assert none.containers == none.documents == 0 and none.fill is None
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer=TOK).count() == 0
