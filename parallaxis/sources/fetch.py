"""Image bytes by id through a fetcher of choice, with a stored table as cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import with_backoff

SCHEMA = "id string, data binary, error string"


def fetch(ids: DataFrame, get: Callable[[str], bytes | None], at_once: int = 8) -> DataFrame:
    """(id, data, error) for each id. At most `at_once` requests run at a time; a failure is a row with an error, not a lost task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_ in batch["id"]:
                try:
                    data = get(id_)
                    rows.append((id_, data, None if data else "empty"))
                except Exception as e:  # whatever the fetcher raises belongs to this id alone
                    rows.append((id_, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "data", "error"])

    return ids.select("id").distinct().repartition(at_once).mapInPandas(run, SCHEMA)


def polite(get: Callable[[str], object], delay: float = 0.1, retries: int = 5, wait: float = 60.0) -> Callable[[str], bytes | None]:
    """get with a delay before each request, waits while it answers 429, and the answer's bytes (or the bytes that get gives)."""

    def paced(id_: str) -> bytes | None:
        answer = with_backoff(lambda: get(id_), delay, retries, wait)
        code = getattr(answer, "status_code", 200)
        if code != 200:
            raise OSError(f"status {code}")
        return getattr(answer, "content", answer)

    return paced


def fetch_missing(ids: DataFrame, stored: DataFrame, get: Callable[[str], bytes | None], at_once: int = 8) -> DataFrame:
    """What the store lacks; stored rows with an error are tried again."""
    good = stored.where("error is null").select("id")
    return fetch(ids.select("id").distinct().join(good, "id", "left_anti"), get, at_once)


def ready_pairs(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs both of whose images are stored."""
    have = stored.where("error is null").select("id")
    left = pairs.join(have.withColumnRenamed("id", "id_left"), "id_left", "left_semi")
    return left.join(have.withColumnRenamed("id", "id_right"), "id_right", "left_semi")


def pair_folder(pairs: DataFrame, base: str) -> DataFrame:
    """pairs with column folder: base, the first two characters of the left id, then left_right."""
    shard = F.coalesce(F.nullif(F.substring("id_left", 1, 2), F.lit("")), F.lit("no_id"))
    return pairs.withColumn("folder", F.concat_ws("/", F.lit(base), shard, F.concat_ws("_", "id_left", "id_right")))
