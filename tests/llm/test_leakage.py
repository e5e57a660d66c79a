import random

import numpy as np

from codelattice.llm.leakage import Seeds, compare, leaks, least_edits, tile
from codelattice.llm.words import words

rnd = random.Random(8)
VOCAB = [f"w{i}" for i in range(400)]
PASSAGES = {i: [rnd.choice(VOCAB) for _ in range(rnd.randint(30, 70))] for i in range(12)}


def slow_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def slow(p, t):
    run = best = 0
    for d in range(-len(p), len(t)):
        run = 0
        for i in range(len(p)):
            run = run + 1 if 0 <= d + i < len(t) and p[i] == t[d + i] else 0
            best = max(best, run)
    return best >= 13 or slow_edits(p, t) <= len(p) // 5


def texts():
    out = []
    for i, p in PASSAGES.items():
        noise = [rnd.choice(VOCAB) for _ in range(60)]
        q = list(p)
        for at in range(3, len(q), rnd.choice([4, 5, 6])):
            q[at] = rnd.choice(["zz", q[at] + "x"])
        out += [noise[:20] + p + noise[20:], noise[:9] + q + noise[9:], noise + p[4:16], noise + p[4:17], p[len(p) // 2 :] + noise + p[: len(p) // 2]]
    return out


def test_against_brute_force():
    seeds = Seeds(list(PASSAGES.items()), 13, 5)
    ts = texts()
    got = {(d, i) for d, i, *_ in compare([" ".join(t) for t in ts], seeds)}
    assert got == {(d, i) for d, t in enumerate(ts) for i, p in PASSAGES.items() if slow(p, t)}


def test_short_passages_and_edits():
    short = {1: ["a"], 2: ["a", "b"], 3: list("abcdefghij"), 4: list("abcde")}
    seeds = Seeds(list(short.items()), 13, 5)
    for _ in range(60):
        t = [rnd.choice("abcdefghijk") for _ in range(rnd.randrange(1, 30))]
        assert {i for _, i, *_ in compare([" ".join(t)], seeds)} == {i for i, p in short.items() if slow(p, t)}
    for _ in range(50):
        p, t = [[rnd.randrange(5) for _ in range(rnd.randrange(1, 25))] for _ in "pt"]
        assert least_edits(np.array(p), np.array(t)) == min(len(p), slow_edits(p, t))


def test_tiling_uses_no_word_twice():
    tiles = tile([(6, 0, 0), (5, 4, 10), (4, 20, 3)], 2)
    assert sorted(tiles) == [(3, 6, 12), (6, 0, 0)] or sum(t[0] for t in tiles) <= 11
    used = [d + i for n, d, _ in tiles for i in range(n)]
    assert len(used) == len(set(used))


def test_markup_and_layout():
    p = " ".join(PASSAGES[0]).title()
    variants = [p.upper(), "<p>" + p.replace(" ", "</b> <b>") + "</p>", "\n".join(f"> {w}" for w in p.split()), "\n".join(f" {i:3d} | {w}" for i, w in enumerate(p.split(), 1)), '{"t": "' + p.replace(" ", "\\n") + '"}', "\r\n".join(f"+**{w}**," for w in p.split()), p.replace(" ", "&nbsp;"), p.replace(" ", " \n# ")]
    seeds = Seeds([(0, PASSAGES[0])], 13, 5)
    found = list(compare(variants, seeds))
    assert [d for d, *_ in found] == list(range(len(variants)))
    assert all(n == len(PASSAGES[0]) for _, _, n, _, _ in found)
    assert words(None) == [] and words("A-b_c é9") == ["a", "b", "c", "é9"]


def test_operator(spark):
    docs = [(i, " ".join(t), 1) for i, t in enumerate(texts())] + [(900, None, 1), (901, "", 1), (0, " ".join(texts()[0]), 1), (902, "x" * 200_000 + " y" * 100_000, 1)]
    items = [(i, " ".join(p), "q") for i, p in PASSAGES.items()] + [(50, None, "q"), (51, "", "q"), (3, " ".join(PASSAGES[3]), "q")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, passage string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, i).collect()}
    assert got == {(a, b) for a, t, _ in docs if t and a < 900 for b, p in PASSAGES.items() if slow(p, t.split())}
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    from codelattice.llm import leakage

    monkeypatch.setattr(leakage, "BLOCK_WORDS", 80)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts())], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in PASSAGES.items()], "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} >= {(5 * i, i) for i in PASSAGES}


def test_reordered_pieces_are_found_by_coverage(spark):
    pieces = lambda p: [p[i : i + 9] for i in range(0, len(p), 9)]
    mixed = {i: [x for part in reversed(pieces(p)) for x in part] for i, p in PASSAGES.items()}
    half = {i: [x for part in reversed(pieces(p[: len(p) // 2])) for x in part] for i, p in PASSAGES.items()}
    docs = [(i, " ".join(["before", *w, "after"])) for i, w in mixed.items()] + [(100 + i, " ".join(w)) for i, w in half.items()] + [(200 + i, " ".join(p)) for i, p in PASSAGES.items()]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in PASSAGES.items()], "item_id long, passage string")
    assert {(r.doc_id, r.item_id): r.reordered for r in leaks(d, items, reordered=True).collect()} == {(i, i): True for i in PASSAGES} | {(200 + i, i): False for i in PASSAGES}
    assert {r.doc_id for r in leaks(d, items).collect()} == {200 + i for i in PASSAGES}


def test_the_coverage_floor_loses_nothing():
    rnd2 = random.Random(21)
    for n in (5, 9, 12, 20, 31, 64):
        p = [rnd2.choice("abcdefgh") for _ in range(n)]
        seeds = Seeds([(1, p)], 13, 5)
        for _ in range(120):
            t = [rnd2.choice("abcdefgh") for _ in range(rnd2.randrange(10))]
            q = list(p)
            for _ in range(n // 5):
                at, what = rnd2.randrange(len(q)), rnd2.randrange(3)
                q[at : at + 1] = [[], ["x"], [q[at], "x"]][what]
            t += q + [rnd2.choice("abcdefgh") for _ in range(rnd2.randrange(10))]
            assert bool(list(compare([" ".join(t)], seeds))) == slow(p, t)
