"""Reading level of each document: boosted trees over length, vocabulary, syntax and cohesion.

The trees are fitted on a bounded sample of labelled documents (``MAX_LABELLED``), every
fold and the final model in a task of its own; measures and predictions cover every
document, whole, in one pass without a shuffle.  Folds of the cross-validation hold out
whole sources.  The held-out predictions also set the cut points between levels, so that
grades are calibrated, and give the quality for each source (``grade_quality``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelattice.llm.boosting import Boosted
from codelattice.llm.prose import Measures, language
from codelattice.llm.words import slices

LEVELS, LEAST_WORDS, MAX_LABELLED, FOLDS, LEAST_LABELLED = 5, 30, 6_000, 4, 20


class Grader:
    """A fitted model with its cut points and its quality on held-out sources."""

    def __init__(self, y: np.ndarray, sources: list[str], kept: np.ndarray, model: Boosted):
        """``kept`` are predictions of models that have not seen the document's source, NaN where there is none."""
        held = ~np.isnan(kept)
        self.model, self.labelled = model, len(y)
        self.cuts = _cuts(kept[held], y[held]) if held.sum() >= LEAST_LABELLED else np.arange(1, LEVELS) + 0.5
        level = self._level(kept[held])
        by: dict[str, list[tuple[float, float, float]]] = {}
        for s, p, a, b in zip(np.array(sources, object)[held], kept[held], level, y[held], strict=True):
            by.setdefault("" if s is None else str(s), []).append((abs(a - b) <= 0.5, abs(a - b) < 1.5, (p - b) ** 2))
        #: (source, held-out labelled documents, share of right levels, share at most one level off, root mean square error)
        self.quality = [(s, len(r), *map(float, np.mean(r, axis=0)[:2]), float(np.sqrt(np.mean(r, axis=0)[2]))) for s, r in sorted(by.items())]

    def _level(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, p, side="right") + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._level(self.model.predict(x))


def _cuts(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cut points between neighbouring levels that misplace the least held-out mass."""
    cuts = []
    for k in range(1, LEVELS):
        grid = np.linspace(k + 0.25, k + 0.75, 41)
        miss = [(np.abs(y - k - 0.5) * ((p >= c) != (y > k + 0.5)))[y != k + 0.5].sum() + 1e-6 * abs(c - k - 0.5) for c in grid]
        cuts.append(grid[int(np.argmin(miss))])
    return np.maximum.accumulate(np.array(cuts))


def _measured(texts: list, langs: list, measures: Measures, least_words: int):
    """Which texts are English with enough prose, and their measures."""
    n, counts, x = measures.batch(texts)
    ok = np.array([n[i] >= least_words and language(counts[i], int(n[i]), langs[i]) == "en" for i in range(len(texts))], bool)
    return ok, x


def fit_grader(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, least_words: int = LEAST_WORDS) -> Grader | None:
    """Fit on at most ``max_labelled`` labelled documents, chosen by hashed id; None if there are too few."""
    y = labels.where(F.col("reading_level").between(1, LEVELS)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("reading_level").alias("level"))
    y = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").join(y, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = Measures()
        for b in (part for whole in batches for part in slices(whole)):
            ok, x = _measured(b.column("text").to_pylist(), b.column("lang").to_pylist(), measures, least_words)
            at = np.flatnonzero(ok)
            if len(at):
                t = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(t), b.column("level").take(t), b.column("source").take(t), pa.array(list(x[at]), pa.list_(pa.float64()))], ["doc_id", "level", "source", "x"])

    got = rows.mapInArrow(run, "doc_id long, level double, source string, x array<double>").toPandas()
    if len(got) < LEAST_LABELLED:
        return None
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    return _fit(documents.sparkSession, np.stack(got["x"].to_numpy()), got["level"].to_numpy(), got["source"].tolist())


def _fit(spark, x: np.ndarray, y: np.ndarray, sources: list) -> Grader:
    """All folds and the final model side by side, a task each; what they return is one model and held-out predictions."""
    fold = np.array([crc32(str(s).encode()) % FOLDS for s in sources])
    sent = spark.sparkContext.broadcast((x, y, fold))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys, f = sent.value
            for k in b.column("id").to_pylist():
                if k == FOLDS:
                    out = pickle.dumps(Boosted().fit(xs, ys))
                elif (f == k).any() and (f != k).sum() >= LEAST_LABELLED:
                    out = pickle.dumps(Boosted(seed=k).fit(xs[f != k], ys[f != k]).predict(xs[f == k]))
                else:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([out], pa.binary())], ["fold", "out"])

    got = {r["fold"]: pickle.loads(r["out"]) for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(train, "fold long, out binary").collect()}
    kept = np.full(len(y), np.nan)
    for k in range(FOLDS):
        if k in got:
            kept[fold == k] = got[k]
    return Grader(y, sources, kept, got[FOLDS])


def reading_levels(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, reading_level)`` of each English document with ``least_words`` words of running prose.

    Levels run from 1 (easiest) to 5.  Null and empty texts, other languages and texts with
    too little prose give no row; a repeated document gives a repeated row; labels that are
    null or out of range don't count, and with fewer than 20 usable ones the level is null;
    further columns are not read.
    """
    grader = fit_grader(documents, labels, max_labelled, least_words)
    sent = documents.sparkSession.sparkContext.broadcast(grader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures, grade = Measures(), sent.value
        for b in (part for whole in batches for part in slices(whole)):
            ok, x = _measured(b.column("text").to_pylist(), b.column("lang").to_pylist(), measures, least_words)
            at = np.flatnonzero(ok)
            if len(at):
                level = pa.array(grade(x[at]), pa.int32()) if grade else pa.nulls(len(at), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), level], ["doc_id", "reading_level"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return docs.mapInArrow(run, "doc_id long, reading_level int")


def grade_quality(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(source, labelled, exact, within_one, rmse)``: how well levels of a source are met by models that have not seen it.

    A null source is an empty one; with fewer than 20 usable labels there is no row.
    """
    grader = fit_grader(documents, labels, max_labelled, least_words)
    return documents.sparkSession.createDataFrame(grader.quality if grader else [], "source string, labelled long, exact double, within_one double, rmse double")
