"""Quality rules of documents and of their hosts, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines, words in repeated 8-word
windows) and rule failures from them. Failures are added up by host (the host of source
where that is a URL, else source itself, which stands for one); a
beta prior fitted to all hosts by moments shrinks each host's failure rates, so a
host with few documents stays near the common rate. A host whose shrunk rate of any
rule is above one half beyond doubt (DOUBT posterior deviations) is rejected, and
its verdict is joined back to its documents.

Repeated windows are found per text: windows are hashed, and only texts with an equal
pair of hashes sort them; equal neighbours are then compared word by word.

Null text counts as empty: no words, so it fails. A null source has no host verdict.
Repeated rows and ids are judged each. Hosts of equal rates get equal verdicts. Texts of
any length are counted whole. An empty table gives an empty result. Columns other than
doc_id, text and source play no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, WORD_CLASS, documents, materialize

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
MOST_SYMBOL_PERCENT = 10
MOST_DUP_LINES_PERCENT = 30
DOUBT = 2.0
RULES = ("short", "repeats", "symbols", "dup_lines")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _repeated_words() -> Column:
    """Words covered by windows that occur twice or more; from columns words, hashes (of windows)."""
    last = F.size("hashes") - 1
    ordered = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def window_at(i: Column) -> Column:
        return F.slice("words", i + 1, WINDOW)

    def same(ordered: Column, k: Column, other: Column) -> Column:
        here, there = F.get(ordered, k), F.get(ordered, other)
        return (here["h"] == there["h"]) & (window_at(here["i"]) == window_at(there["i"]))

    def with_ordered(ordered: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & same(ordered, k, k - 1)) | ((k < last) & same(ordered, k, k + 1)),
        )
        return F.sort_array(F.transform(places, lambda k: F.get(ordered, k)["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), s - F.get(starts, k - 1)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # one-element arrays bind a value to a name inside an expression, so it is computed once
    bound = F.transform(F.array(ordered), with_ordered)
    return F.element_at(F.transform(bound, covered), 1)


def host_of(source: Column) -> Column:
    """The host of a URL in small letters; whatever else it is stays as it is."""
    host = F.lower(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host).otherwise(source)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source (its host) and the counts of each row. No shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD_CLASS))
    step = docs.select(F.col("doc_id").cast("long"), host_of(F.col("source").cast("string")).alias("source"), text.alias("text"))
    step = step.select("doc_id", "source", "text", words(F.col("text")).alias("words"), lines.alias("lines"))
    step = step.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get("word_hashes", i + k) for k in range(WINDOW))))
    step = step.withColumn("hashes", F.coalesce(hashes, F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return step.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(repeats, _repeated_words()).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES_PERCENT * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """source, n_docs, shrunk rate of each rule, host_rejected. The prior's few numbers pass through the driver."""
    hosts = (
        measured.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(f.cast("long")).alias(f"n_{r}") for r, f in failures().items()))
    )
    moments = hosts.agg(
        *(F.avg(F.col(f"n_{r}") / F.col("n_docs")).alias(f"m_{r}") for r in RULES),
        *(F.var_pop(F.col(f"n_{r}") / F.col("n_docs")).alias(f"v_{r}") for r in RULES),
    ).first()
    rates, doubts = {}, {}
    for r in RULES:
        a, b = beta_prior(moments[f"m_{r}"], moments[f"v_{r}"])
        size = F.col("n_docs") + F.lit(a + b)
        rates[r] = (F.col(f"n_{r}") + F.lit(a)) / size
        doubts[r] = F.sqrt(rates[r] * (1 - rates[r]) / (size + 1))
    rejected = reduce(lambda x, y: x | y, (rates[r] - F.lit(DOUBT) * doubts[r] > 0.5 for r in RULES))
    return hosts.select("source", "n_docs", *(rates[r].alias(f"host_{r}") for r in RULES), rejected.alias("host_rejected"))


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Moments to beta parameters; strength between 2 and 1000, and a uniform prior without hosts."""
    if mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    strength = mean * (1 - mean) / variance - 1 if variance else 1000.0
    strength = min(max(strength, 2.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row: counts, base_failed, host_rejected and kept."""
    measured = materialize(measure(docs), "quality")  # a few numbers a row: texts are read and split once
    rejected = host_verdicts(measured).where("host_rejected").select("source", "host_rejected")
    base = failures()["short"] | failures()["repeats"]
    return (
        measured.join(rejected, "source", "left")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )
