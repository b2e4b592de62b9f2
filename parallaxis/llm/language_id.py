"""Language identification by rank-order n-gram profiles (out-of-place distance).

Training counts the letter n-grams (1 to 3 letters, words padded by a blank) of every
training document per language, and keeps the most frequent ones in order: the
language's profile. A document's own most frequent n-grams are ranked in the same
way; each adds the difference of its two ranks, or the full profile length where the
language's profile lacks it. The language with the smallest sum wins.

n-grams are exact: one number holds the code points of up to three letters. Ties of count
are ordered by code points, ties of distance by the language's name. Null text, or text
without a letter, gets "und" with score 0. score is the winner's similarity, 1 - distance
/ largest distance. Any length of text is counted whole; repeated rows count each; an
empty table, or one without labelled rows, teaches no language, and all texts get "und".
A table's own columns keep their names, but for lang_pred and score in predict().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import documents, fresh, id_bucket, map_batches

PROFILE = 400
#: Different n-grams of a language that a training task holds before it passes them on.
HELD_GRAMS = 1 << 20
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"

_letter_cache: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to lower-case code point if it is a letter, else 0 (built once in a process)."""
    if not _letter_cache:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letter_cache.append(table)
    return _letter_cache[0]


_BLANK, _WIDTH = np.uint64(32), np.uint64(21)


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The different n-grams of a whole text, as numbers in order, and their counts; None without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points]
    inside = letters != 0
    if not inside.any():
        return None
    # one blank between words: drop every non-letter that follows a non-letter
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    line = np.concatenate(([np.uint32(0)], letters[keep], [np.uint32(0)])).astype(np.uint64)
    blank = line == 0
    line[blank] = _BLANK
    two = (line[:-1] << _WIDTH) | line[1:]
    three = (two[:-1] << _WIDTH) | line[2:]
    # a blank in the middle of three would span two words
    every = np.concatenate((line[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]))
    return np.unique(every, return_counts=True)


def spelt(gram: int) -> str:
    """The letters of an n-gram's number."""
    out = ""
    while gram:
        out, gram = chr(gram & 0x1FFFFF) + out, gram >> 21
    return out


def top_grams(grams: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code points."""
    return grams[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """ranks[language, i] is the place of grams[i] in that language's profile, or PROFILE; the last column is for all others."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), PROFILE, np.int32)
        for i, name in enumerate(self.languages):
            own = np.array(profiles[name], np.uint64)
            self.ranks[i, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams_of(text) if text else None
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        own = top_grams(*found)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        theirs = self.ranks[:, at]
        steps = np.where(theirs < PROFILE, np.abs(theirs - np.arange(len(own))), PROFILE)
        distance = steps.sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], float(1.0 - distance[best] / (PROFILE * len(own)))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows with text and language outside the held-out fold."""
    return docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket("doc_id", FOLDS) != HELD_OUT)
    ).select("lang", "text")


def fit(docs: DataFrame) -> DataFrame:
    """(lang, gram, place): each language's profile from all training rows.

    A task adds up its own rows; only the first PROFILE rows of a partition are ranked for a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([n for _, n in held[lang]]), len(grams))
            return grams, sums.astype(np.int64)

        def rows(lang: str) -> pa.RecordBatch:
            grams, n = merged(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := grams_of(text)) is not None:
                    held.setdefault(lang, []).append(found)
                    sizes[lang] = sizes.get(lang, 0) + len(found[0])
                    if sizes[lang] >= HELD_GRAMS:
                        held[lang] = [merged(lang)]
                        sizes[lang] = len(held[lang][0][0])
                        if 2 * sizes[lang] >= HELD_GRAMS:
                            yield rows(lang)
                            held[lang], sizes[lang] = [], 0
        for lang in held:
            if held[lang]:
                yield rows(lang)

    grams = (
        map_batches(training_rows(docs), count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    return ranked.select("lang", "gram", (F.col("rank") - 1).alias("place"))


def load(profile: DataFrame) -> Profiles:
    """PROFILE rows a language, on the driver."""
    out: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(profile.select("lang", "gram", "place").collect(), key=lambda r: (r[0], r[2])):
        out.setdefault(lang, []).append(gram)
    return Profiles(out)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of docs, plus lang_pred and score (own columns of these names are replaced). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return map_batches(docs, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training fold of docs and predict every row."""
    return predict(docs, load(fit(docs)))


def keep_identified(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """docs without rows that have no letter, or that are unlike every learned language; all columns stay.

    Without any labelled row there is no language to tell from, and nothing is dropped.
    """
    profiles = load(fit(docs))
    if not profiles.languages:
        return docs
    own = {c: fresh(docs, f"own_{c}") for c in ("lang_pred", "score") if c in docs.columns}
    found = predict(docs.withColumnsRenamed(own), profiles).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = load(fit(docs))
    return predict(docs.select(F.col("doc_id").cast("long"), "text"), profiles).select(
        "doc_id",
        F.coalesce(id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS
