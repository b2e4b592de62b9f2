"""Toxicity by cumulative-link ordinal regression over sparse text features.

One weight vector serves all grades; the thresholds between grades are ordered. For a
document with feature sum s, P(grade > j) = logistic(s - threshold_j), and the
expected grade, the sum of those, is the severity. Features are the words a text has
(letters and digits, lower case) and their beginnings of 4 to 7 characters, present or
not. Features stay that tell toxic from clean documents either way beyond LEAST_RATIO (log-likelihood
ratio, counted on the executors); they are fitted by penalised maximum likelihood.

The labels say toxic or not. Grades of toxic documents, 1 to LEVELS, are the quantiles
of how many features of toxic documents they have beyond what a clean document with as
many features has on average, so that length alone is no severity; 0 is clean. fit() takes any given grades. The fit uses at most SAMPLE_ROWS
labelled documents, those with the smallest hash of doc_id; every document is then scored.

Null text, and text without known features, has the severity of the thresholds alone.
Repeated rows are scored each, and teach once. Labels with nulls or for unknown documents
are ignored; without labels, or with one label only, no document is toxic and severity is
0. An empty table gives no rows. Texts of any length are read whole. Columns other than
doc_id, text and toxic play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, documents, map_batches, materialize

SAMPLE_ROWS = 12_000
BEGINNINGS = (4, 5, 6, 7)
LEAST_DOCUMENTS = 5
LEAST_RATIO = 12.0
PENALTY = 0.05
LEVELS = 3
TOXIC_AT = 0.5
CACHE_WORDS = 400_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The word itself, and its proper beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class OrdinalModel:
    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, tuple[str, ...]] = {}

    def feature_sum(self, text: str | None) -> float:
        known, weights, found = self.known, self.weights, set()
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in words_of(text):
            hits = known.get(word)
            if hits is None:
                hits = known[word] = tuple(f for f in features_of(word) if f in weights)
            if hits:
                found.update(hits)
        return sum(weights[f] for f in sorted(found))

    def above(self, text: str | None) -> list[float]:
        """P(grade > j) for every threshold j."""
        s = self.feature_sum(text)
        return [1 / (1 + np.exp(np.clip(t - s, -30, 30))) for t in self.thresholds]


def telling(k: np.ndarray, k1: np.ndarray, n: int, m: int) -> np.ndarray:
    """Whether features of k documents, k1 of them toxic, tell the m toxic ones of n documents from the others."""
    k, k1 = k.astype(float), k1.astype(float)

    def part(x, e):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)

    ratio = part(k1, k * m / n) + part(k - k1, k * (n - m) / n) + part(m - k1, m * (n - k) / n) + part(n - m - k + k1, (n - m) * (n - k) / n)
    return (k >= LEAST_DOCUMENTS) & (ratio > LEAST_RATIO)


def grades_of(excess: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to LEVELS for toxic ones by their excess of features of toxic documents."""
    edges = np.quantile(excess[toxic], np.arange(1, LEVELS) / LEVELS) if toxic.any() else np.zeros(LEVELS - 1)
    return np.where(toxic, 1 + np.searchsorted(edges, excess, side="left"), 0)


def fit(texts: list[str | None], grades: list | None = None, toxic: list | None = None) -> OrdinalModel:
    """A model of texts that are at hand, with grades, or with labels to make grades of."""
    rows = [sorted({f for w in words_of(t) for f in features_of(w)}) for t in texts]
    positive = np.array(grades if grades is not None else toxic, int) > 0
    k, k1 = Counter(f for r in rows for f in r), Counter(f for r, p in zip(rows, positive, strict=True) if p for f in r)
    every = sorted(k)
    counts = [np.array([c[f] for f in every], np.int64) for c in (k, k1)]
    use = telling(*counts, len(rows), int(positive.sum())) if rows else np.zeros(0, bool)
    names = [f for f, u in zip(every, use, strict=True) if u]
    index = {f: i for i, f in enumerate(names)}
    found = [[index[f] for f in r if f in index] for r in rows]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in found]) if rows else np.zeros(0, np.int64)
    col = np.array([i for r in found for i in r], np.int64)
    given = np.array(grades if grades is not None else toxic, int)
    return fit_sparse(at, col, names, given, np.array([len(r) for r in rows]) if grades is None else None)


def fit_sparse(at: np.ndarray, col: np.ndarray, names: list[str], y: np.ndarray, sizes: np.ndarray | None) -> OrdinalModel:
    """Penalised maximum likelihood; thresholds are a first one and positive gaps. Row at[i] has feature col[i].

    sizes: how many features each row has in all, to make grades of labels; None if y holds grades.
    """
    positive = y > 0
    if not positive.any() or positive.all():
        return OrdinalModel({}, [30.0])
    if sizes is not None:
        ones = np.bincount(col[positive[at]], minlength=len(names))
        bad = ones * len(y) > np.bincount(col, minlength=len(names)) * positive.sum()
        had = np.bincount(at, bad[col], len(y))
        usual = had[~positive].sum() / max(1, sizes[~positive].sum())
        y = grades_of(had - usual * sizes, positive)
    y = np.unique(y, return_inverse=True)[1]  # grades that occur, from 0
    top = int(y.max())
    share = np.clip([(y > j).mean() for j in range(top)], 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    n, m = len(y), len(names)
    rows_index = np.arange(n)

    def thresholds_of(x):
        return np.concatenate([x[m : m + 1], x[m] + np.cumsum(np.exp(x[m + 1 :]))])

    def loss(x):
        """Penalised negative log-likelihood and its gradient."""
        w, t = x[:m], thresholds_of(x)
        s = np.bincount(at, w[col], n)
        # P(grade > j), with certain ends
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -30, 30)))
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        mass = np.maximum(full[rows_index, y] - full[rows_index, y + 1], 1e-12)
        bend = full * (1 - full)
        up, down = bend[rows_index, y] / mass, bend[rows_index, y + 1] / mass
        g_s = down - up
        g_t = np.array([up[y == j + 1].sum() - down[y == j].sum() for j in range(top)])
        g_gaps = np.exp(x[m + 1 :]) * np.cumsum(g_t[::-1])[::-1][1:]
        g = np.concatenate([np.bincount(col, g_s[at], m) + PENALTY * w, [g_t.sum()], g_gaps])
        return -np.log(mass).sum() + PENALTY / 2 * (w @ w), g

    x = _descend(loss, np.concatenate([np.zeros(m), first[:1], gaps]))
    weights = {f: float(v) for f, v in zip(names, x[:m], strict=True) if abs(v) > 1e-3}
    return OrdinalModel(weights, thresholds_of(x).tolist())


def _descend(loss, x: np.ndarray, steps: int = 200, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a halving line search."""
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for dx, dg in reversed(past):
            a = (dx @ d) / (dx @ dg)
            d = d - a * dg
            kept.append(a)
        if past:
            dx, dg = past[-1]
            d = d * ((dx @ dg) / (dg @ dg))
        else:
            d = d / max(1.0, np.abs(g).max())
        for (dx, dg), a in zip(past, reversed(kept), strict=True):
            d = d + dx * (a - (dg @ d) / (dx @ dg))
        step = 1.0
        while step > 1e-8:
            new = x + step * d
            new_value, new_g = loss(new)
            if new_value <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            return x
        dx, dg = new - x, new_g - g
        if dx @ dg > 1e-12:
            past = [*past, (dx, dg)][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, g = new, new_value, new_g
        if done:
            break
    return x


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most `rows` labelled documents."""
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .dropDuplicates(["id"])
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    # picked: 12 bytes a row, at most `rows` rows
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(picked), F.col("doc_id") == F.col("id")
    )
    return found.drop("id").dropDuplicates(["doc_id"])


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model of the labelled sample. Texts stay on the executors, and features are counted and screened there."""
    sample = materialize(labelled_sample(docs, labels, rows), "labelled")
    n, m = sample.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") > 0)).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_, bad = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for w in words_of(text) for f in features_of(w)}
                all_.update(found)
                if toxic > 0:
                    bad.update(found)
            columns = [pa.array(list(all_), pa.string()), pa.array(list(all_.values()), pa.int64()), pa.array([bad[f] for f in all_], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "k", "k1"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = telling(batch.column(1).to_numpy(), batch.column(2).to_numpy(), n, m)
            yield batch.filter(pa.array(use)).select(["feature"])

    counted = map_batches(sample.select("text", "toxic"), count, "feature string, k long, k1 long")
    sums = counted.groupBy("feature").agg(F.sum("k").alias("k"), F.sum("k1").alias("k1")).where(F.col("k") >= LEAST_DOCUMENTS)
    # features that tell, of at most `rows` documents
    names = sorted(r[0] for r in map_batches(sums, screen, "feature string").toLocalIterator())
    shared = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found, sizes = [], []
            for text in batch.column(1).to_pylist():
                features = {f for w in words_of(text) for f in features_of(w)}
                sizes.append(len(features))
                found.append(sorted(index[f] for f in features if f in index))
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "size", "features"])

    schema = "doc_id long, toxic int, size long, features array<int>"
    table = map_batches(sample.select("doc_id", "text", "toxic"), numbers, schema).toArrow()
    discard(sample)
    table = table.combine_chunks().sort_by("doc_id")
    found = table["features"].combine_chunks()
    lengths = np.diff(found.offsets.to_numpy()) if len(table) else np.zeros(0, np.int64)
    col = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return fit_sparse(np.repeat(np.arange(len(table)), lengths), col, names, table["toxic"].to_numpy(), table["size"].to_numpy())


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, p_toxic, severity (expected grade), grade (most that is likelier than not), toxic. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = OrdinalModel(*shared.value)
        for batch in batches:
            rows = [local.above(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([sum(r) for r in rows], pa.float64()),
                    pa.array([sum(p >= TOXIC_AT for p in r) for r in rows], pa.int32()),
                    pa.array([r[0] >= TOXIC_AT for r in rows], pa.bool_()),
                ],
                names=["doc_id", "p_toxic", "severity", "grade", "toxic"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, p_toxic double, severity double, grade int, toxic boolean",
    )


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
