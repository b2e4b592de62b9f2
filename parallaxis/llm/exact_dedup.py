"""Exact deduplication by recipes of content-defined chunks, in DataFrame functions only.

A normalised text (each run of white space is one space) is cut where its content says
so, in any script: after LEAST_CHUNK characters behind the next doubled character or, in
scripts of many characters, behind the next one of every 32nd part of the code points;
or at MOST_CHUNK characters. A text's recipe is the ordered list of its chunks' identifiers.
An identifier is the chunk's hash, verified: over all chunks, the least and the greatest
content of a hash must be the same; where they differ, the contents of that hash are
numbered and the number becomes part of the identifier. Contents cross the network
once, at most once per task and chunk; documents are then compared by recipe alone.

Null text counts as empty; empty texts equal each other. Of equal texts the row with
the smallest doc_id stays (null ids come last); of rows that repeat that id with an
equal text, one. Other columns play no part, whatever their names; an empty table gives
no rows. A group may be any share of all rows: groups are counted by partial sums, and
joined back with splittable joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, documents, fresh, materialize

LEAST_CHUNK, MOST_CHUNK = 192, 2048
#: Eight of each 256 code points from U+3000 to U+D7FF.
_SOME = "".join(f"\\u{block:02X}00-\\u{block:02X}07" for block in range(0x30, 0xD8))
_CUT = rf"(?:(.)\1|(?=[^\x00-\u2FFF])[{_SOME}])"
_CHUNK = rf"(?s).{{{LEAST_CHUNK},{MOST_CHUNK - 2}}}?{_CUT}|.{{1,{MOST_CHUNK}}}"
#: Runs of white space other than one single space.
_UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

Hash = Callable[[Column], Column]


def normalized(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), _UNEVEN_SPACE, " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def _chunked(docs: DataFrame) -> DataFrame:
    step = docs.select(F.col("doc_id").cast("long"), normalized().alias("norm"))
    return step.select("doc_id", "norm", chunks(F.col("norm")).alias("chunks"))


def recipes(docs: DataFrame, hash_of: Hash = F.xxhash64) -> DataFrame:
    """row, doc_id, text_sha256, recipe array<long> of verified identifiers; one row per row, written."""
    cut = _chunked(docs)
    plain = materialize(
        cut.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform("chunks", lambda c: hash_of(c)).alias("recipe"),
        ),
        "recipes",
    )
    contents = cut.select(F.explode("chunks").alias("content")).withColumn("hash", hash_of(F.col("content")))
    doubtful = materialize(
        contents.groupBy("hash")
        .agg(F.min("content").alias("low"), F.max("content").alias("high"))
        .where("low <> high")
        .select("hash"),
        "doubtful",
    )
    if doubtful.isEmpty():
        discard(doubtful)
        return plain
    discard(plain)
    return _renumbered(docs, contents, doubtful, hash_of)


def _renumbered(docs: DataFrame, contents: DataFrame, doubtful: DataFrame, hash_of: Hash) -> DataFrame:
    """Recipes whose identifiers also number the different contents of one hash."""
    numbered = materialize(
        contents.join(doubtful, "hash", "left_semi")
        .distinct()
        .withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("content"))),
        "numbered",
    )
    rows = materialize(
        _chunked(docs).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), "chunks"
        ),
        "chunked",
    )
    parts = rows.select("row", F.posexplode("chunks").alias("at", "content")).withColumn("hash", hash_of(F.col("content")))
    listed = (
        parts.join(numbered, ["hash", "content"], "left")
        .groupBy("row")
        .agg(F.collect_list(F.struct("at", "hash", F.coalesce("number", F.lit(0)).alias("number"))).alias("parts"))
    )
    recipe = F.flatten(
        F.transform(F.sort_array("parts"), lambda p: F.array(p["hash"].cast("long"), p["number"].cast("long")))
    )
    return materialize(
        rows.join(listed, "row", "left").select(
            "row", "doc_id", "text_sha256", F.coalesce(recipe, F.array().cast("array<bigint>")).alias("recipe")
        ),
        "recipes",
    )


def deduplicate(docs: DataFrame, hash_of: Hash = F.xxhash64) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, hash_of).withColumn("recipe_hash", F.xxhash64("recipe"))
    # written, so that both sides of the join come straight from a shuffle, which can split a hot group
    classes = materialize(
        rows.groupBy("recipe_hash", "recipe")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("recipe_hash", "recipe", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"),
        "classes",
    )
    alone = F.col("group_size").isNull()
    return rows.join(classes, ["recipe_hash", "recipe"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that deduplicate() drops; all columns stay, whatever their names."""
    verdicts = materialize(deduplicate(docs), "verdicts")
    own = fresh(docs, "id")
    dropped = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(own))
    stays = verdicts.where("kept").select(F.col("doc_id").alias(own))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    # ids that repeat, with equal or other texts, and null ids: their rows need a look at the text
    both = materialize(
        dropped.join(stays, own, "left_semi").unionByName(dropped.where(F.col(own).isNull())).distinct(), "repeated"
    )
    gone = materialize(dropped.join(both, own, "left_anti").where(F.col(own).isNotNull()).distinct(), "dropped")
    if both.isEmpty():
        return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
    unsure = docs.join(both, same, "left_semi")
    sure = docs.join(gone.unionByName(both), same, "left_anti")
    return sure.unionByName(_pick(unsure, verdicts))


def _pick(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of rows that share an id, the kept texts, one row each; null ids stay only where no other id has the text."""
    mark, own, theirs = fresh(docs, "sha"), fresh(docs, "id"), fresh(docs, "kept_sha")
    keyed = docs.withColumn(mark, F.sha2(normalized(), 256)).dropDuplicates(["doc_id", mark])
    kept = verdicts.where("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(theirs))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(theirs))
    return keyed.join(kept, same, "left_semi").drop(mark)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))
