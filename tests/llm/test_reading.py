import random

import numpy as np

from codelattice.llm.boosting import Boosted
from codelattice.llm.prose import Measures, language, running
from codelattice.llm.reading import grade_quality, reading_levels

EASY, HARD = "cat dog sun box red big run sit top map".split(), "architectural instrumentation interoperability materialization deterministic configuration responsibility heterogeneous".split()


def text(level, rnd):
    out = []
    for _ in range(rnd.randint(8, 14)):
        n = 4 + 3 * level
        out.append(" ".join(rnd.choice(HARD if rnd.random() < (level - 1) * 0.18 else EASY) if i % 3 else rnd.choice(["the", "of", "and", "is"]) for i in range(n)).capitalize() + ".")
    return " ".join(out)


def test_boosting_learns_and_bears_odd_input():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = x[:, 0] * 2 + (x[:, 1] > 0)
    m = Boosted().fit(x[:600], y[:600])
    assert np.sqrt(((m.predict(x[600:]) - y[600:]) ** 2).mean()) < 0.5 * y.std()
    flat = Boosted(trees=3).fit(np.ones((30, 2)), np.full(30, 2.0))
    assert np.allclose(flat.predict(np.array([[np.nan, 1.0]])), 2.0)


def test_running_prose():
    t = "# Title here\n\nThis is a line of prose that goes on. It has two sentences.\n\n```go\nfunc x() { return 1 }\n```\n- a list item that is not prose at all.\n| a | b |\n2026-01-02T03:04:05Z level=info msg=x\n{\"a\": 1}\n> Quoted words are prose as well, they say.\r\n<p>And <b>tags</b> are taken off here.</p>\n\tfoo := bar(x)\n"
    got = running(t)
    assert "two sentences" in got and "quoted words" in got and "tags" in got
    assert not any(x in got for x in ("title", "func", "list item", "level", "foo", '"a"'))
    assert running(None) == "" and running("") == ""


def test_batch_equals_single():
    rnd = random.Random(2)
    texts = [text(i % 5 + 1, rnd) for i in range(20)] + [None, "", "one two", "x" * 100_000, "... !!! ,,,"]
    n, langs, x = Measures().batch(texts)
    for i, t in enumerate(texts):
        n1, l1, x1 = Measures().batch([t])
        assert n1[0] == n[i] and np.allclose(x1[0], x[i], rtol=1e-5, atol=1e-6) and np.allclose(l1[0], langs[i])


def test_language():
    m = Measures()
    n, c, _ = m.batch(["The cat is in the house and it has a box for you to see with them. That is not what we have seen.", "Der Hund ist nicht im Haus und die Katze wird auch nicht mit dem Ball spielen. Das ist nicht gut für uns."])
    assert language(c[0], n[0], None) == "en" and language(c[1], n[1], None) == "de"
    assert language(np.zeros(4), 0, "EN-us") == "en" and language(np.zeros(4), 0, None) is None


def test_levels_on_held_out(spark):
    rnd = random.Random(5)
    docs = [(i, text(i % 5 + 1, rnd), ["en", "EN", "en-US", None][i % 4], f"s{i % 9}", 7) for i in range(900)]
    labels = [(i, "a", i % 5 + 1) for i in range(400)] + [(i, "b", min(5, i % 5 + 1 + (i % 17 == 0))) for i in range(0, 400, 2)] + [(3, "c", None), (4, "c", 99), (None, "a", 3)]
    extra = [(2000, "", "en", "s", 1), (2001, None, None, None, 1), (2002, "Der Hund ist nicht im Haus und die Katze wird auch nicht mit dem Ball spielen. " * 5, "de", "s", 1), (2003, "Short one here.", "en", "s", 1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, reading_level long")
    lb = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_levels(d, lb).collect()}
    assert set(got) == set(range(900))
    held = [got[i] == i % 5 + 1 for i in range(400, 900)]
    assert sum(held) / len(held) >= 0.8
    assert {r.reading_level for r in reading_levels(d, lb.limit(0)).collect()} == {None}
    assert reading_levels(d.limit(0), lb).count() == 0
    quality = grade_quality(d, lb).collect()
    assert len(quality) == 9 and sum(r.labelled for r in quality) == 400 and all(0 <= r.exact <= r.within_one <= 1 for r in quality)
    assert sum(r.exact * r.labelled for r in quality) / 400 > 0.6 and sum(r.within_one * r.labelled for r in quality) / 400 > 0.95
    assert grade_quality(d, lb.limit(0)).count() == 0
