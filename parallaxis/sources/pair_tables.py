"""Pairs that are given: explicit or grouped CSV rows, neighbour documents, folders and file names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem, first_value
from ..operators.ordering import positions

# The names under which a column may come.
SIDES = {
    "filename_left": ("filename_left", "left_filename", "filename_1", "filename_a"),
    "filename_right": ("filename_right", "right_filename", "filename_2", "filename_b"),
    "id_left": ("id_left", "left_id", "id_1", "id_a"),
    "id_right": ("id_right", "right_id", "id_2", "id_b"),
    "date_left": ("date_left", "left_date", "date_1", "date_a"),
    "date_right": ("date_right", "right_date", "date_2", "date_b"),
}
NO_DATE = "N/A"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; broken lines are skipped."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)


def is_explicit(columns: list[str]) -> bool:
    return all(set(columns) & set(SIDES[side]) for side in ("filename_left", "filename_right"))


def load(table: DataFrame, order: str, indices: list | None = None, most: int | None = None) -> DataFrame:
    """Explicit or grouped pairs by the columns at hand; order is the column of the input's row order."""
    if is_explicit(table.columns):
        return explicit_pairs(table, order, indices)
    return grouped_pairs(table, order, indices, most)


def _wanted(table: DataFrame, indices: list | None) -> DataFrame:
    if not indices:
        return table
    if "index" not in table.columns:
        raise ValueError("indices need an index column")
    return table.where(F.col("index").cast("string").isin([str(i) for i in indices]))


def explicit_pairs(table: DataFrame, order: str, indices: list | None = None) -> DataFrame:
    """One pair a row. Missing ids come from the file's stem, missing indexes from the row's number.

    Row numbers are dealt by range partitions, not in one task.
    """
    rows = positions(_wanted(table, indices), order, name="__n").withColumn("__n", F.col("__n") + 1)

    def side(name: str) -> Column:
        return first_value(*(F.col(c) for c in SIDES[name] if c in table.columns), F.lit(None))

    def named(which: str) -> Column:
        name = side(f"filename_{which}")
        spare = F.concat(F.lit("row"), F.col("__n").cast("string"), F.lit(f"_{which}"))
        return F.coalesce(side(f"id_{which}"), file_stem(name), spare)

    def file_(which: str) -> Column:
        name = side(f"filename_{which}")
        return F.when(name.isNotNull(), name).otherwise(F.raise_error(F.lit("a pair row lacks a file name")))

    index = first_value(F.col("index")) if "index" in table.columns else F.lit(None).cast("string")
    return rows.select(
        named("left").alias("id_left"),
        named("right").alias("id_right"),
        F.coalesce(side("date_left"), F.lit(NO_DATE)).alias("date_left"),
        F.coalesce(side("date_right"), F.lit(NO_DATE)).alias("date_right"),
        file_("left").alias("filename_left"),
        file_("right").alias("filename_right"),
        F.coalesce(index, F.col("__n").cast("string")).alias("index"),
    )


def grouped_pairs(table: DataFrame, order: str, indices: list | None = None, most: int | None = None) -> DataFrame:
    """All pairs inside each index in row order, at most `most` of an index (first ones first)."""
    lacking = {"index", "id", "filename"} - set(table.columns)
    if lacking:
        raise ValueError(f"expected pair columns, or index, id and filename; lacking {sorted(lacking)}")
    date = F.col("date").cast("string") if "date" in table.columns else F.lit(NO_DATE)
    rows = _wanted(table, indices).select(
        F.col("index").cast("string").alias("index"),
        F.col("id").cast("string").alias("id"),
        "filename",
        date.alias("date"),
        F.row_number().over(Window.partitionBy("index").orderBy(order)).alias("n"),
    )
    left, right = rows.alias("l"), rows.alias("r")
    pairs = left.join(right, (F.col("l.index") == F.col("r.index")) & (F.col("l.n") < F.col("r.n")))
    chosen = list(
        chain.from_iterable(
            (F.col(f"{a}.{c}").alias(f"{c}_{side}") for c in ("id", "date", "filename"))
            for a, side in (("l", "left"), ("r", "right"))
        )
    )
    out = pairs.select(*chosen, F.col("l.index").alias("index"), F.col("l.n").alias("n_left"), F.col("r.n").alias("n_right"))
    return first_of_group(out, "index", ["n_left", "n_right"], most).drop("n_left", "n_right")


def first_of_group(rows: DataFrame, group: str, order: list[str], most: int | None) -> DataFrame:
    """The first `most` rows of each group; all of them for None or 0."""
    if not most:
        return rows
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def neighbour_pairs(points: DataFrame, seed: int = 42) -> DataFrame:
    """point_info struct<id_left, ...> and conflicting_neighbors array<struct<id, ...>> to pairs in a seeded order."""
    pairs = points.select(
        F.col("point_info.id_left").cast("string").alias("id_left"),
        F.explode("conflicting_neighbors").alias("neighbour"),
    ).select("id_left", F.col("neighbour.id").cast("string").alias("id_right"), "neighbour")
    return pairs.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "id_left", "id_right")))


def resolve_files(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """wanted(key, filename, id) to path, by priority: exact name, name in any case, id.png, id.jpg, id.jpeg likewise."""
    names = listing.select(F.col("name").alias("have"), F.lower("name").alias("low")).distinct()
    tries = F.array(
        *(
            F.struct(F.lit(2 * i).alias("p"), t.alias("exact"))
            for i, t in enumerate(
                [F.col("filename"), *(F.concat(F.col("id"), F.lit(e)) for e in (".png", ".jpg", ".jpeg"))]
            )
        )
    )
    each = wanted.select("key", F.explode(tries).alias("t")).select("key", "t.p", "t.exact")
    found = each.join(names, F.lower("exact") == F.col("low")).select(
        "key", F.when(F.col("exact") == F.col("have"), F.col("p")).otherwise(F.col("p") + 1).alias("p"), "have"
    )
    best = found.groupBy("key").agg(F.min(F.struct("p", "have")).alias("best"))
    return wanted.join(best, "key", "left").select(*wanted.columns, F.col("best.have").alias("path"))


def folder_pairs(files: DataFrame) -> DataFrame:
    """Folders named left_right that hold left.png and right.png; from a listing of (folder, name)."""
    halves = F.split(F.col("folder"), "_", 2)
    split_ = files.where(F.contains(F.col("folder"), F.lit("_"))).select(
        "folder", halves[0].alias("id_left"), halves[1].alias("id_right"), "name"
    )

    def has(side: str) -> Column:
        return F.max((F.col("name") == F.concat(F.col(side), F.lit(".png"))).cast("int")) == 1

    both = split_.groupBy("folder", "id_left", "id_right").agg((has("id_left") & has("id_right")).alias("both"))
    return both.where("both").select("folder", "id_left", "id_right")


MANIFEST_COLUMNS = ("id_left", "date_left", "id_right", "date_right", "left_path", "right_path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV with all its columns, or an error that names the missing ones."""
    table = read_csv(spark, path)
    lacking = [c for c in MANIFEST_COLUMNS if c not in table.columns]
    if lacking:
        raise ValueError(f"manifest lacks {', '.join(lacking)}")
    return table.select(*MANIFEST_COLUMNS)
