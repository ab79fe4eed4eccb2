"""First-wins deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored as store

#: Rows of a component up to which one task goes through it row by row; larger ones are settled in rounds.
COMPONENT_ROWS = 2_000_000


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order`` (unique); combines before the shuffle, so a hot key is one row a task.

    A null key equals no other, so its rows all stay: each is grouped by its ``order``
    instead, in the same pass.
    """
    alone = F.when(F.col(key).isNull(), F.col(order))
    first = df.groupBy(F.col(key).alias("_key"), alone.alias("_alone")).agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("_row"))
    return first.select("_row.*")


def _round(undecided: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, still undecided): rows that come first in both their groups, and rows that share no key with them."""
    by_url = undecided.groupBy("_u").agg(F.min(order).alias("_mu"))
    by_hash = undecided.groupBy("_h").agg(F.min(order).alias("_mh"))
    marked = undecided.join(by_url, "_u").join(by_hash, "_h")
    marked = store(marked.withColumn("_win", (F.col(order) == F.col("_mu")) & (F.col(order) == F.col("_mh"))).drop("_mu", "_mh"))
    won = marked.filter("_win")
    rest = marked.filter("not _win").drop("_win").join(won.select("_u"), "_u", "left_anti").join(won.select("_h"), "_h", "left_anti")
    return won.select(order), store(rest.select(order, "_u", "_h"))


def components(rows: DataFrame, order: str) -> DataFrame:
    """Rows (order, _u, _h) with ``_c``: the least ``order`` that is reached through shared keys.

    In each round a row takes the least label among those it shares a key with, and
    so does the row that its old label names; then labels are followed one step.  So
    trees of labels merge at their roots and halve in depth: the rounds grow with the
    logarithm of the longest chain.
    """
    now = store(rows.select(order, "_u", "_h", F.col(order).alias("_c")))
    while True:
        by_url = now.groupBy("_u").agg(F.min("_c").alias("_mu"))
        by_hash = now.groupBy("_h").agg(F.min("_c").alias("_mh"))
        near = store(now.join(by_url, "_u").join(by_hash, "_h").withColumn("_least", F.least("_mu", "_mh")).drop("_mu", "_mh"))
        lower = near.filter(F.col("_least") < F.col("_c"))
        if lower.isEmpty():
            return near.select(order, "_u", "_h", "_c")
        hooks = lower.groupBy(F.col("_c").alias(order)).agg(F.min("_least").alias("_hook"))
        moved = store(near.join(hooks, order, "left").select(order, "_u", "_h", F.least("_least", F.coalesce("_hook", "_least")).alias("_c")))
        jump = moved.select(F.col(order).alias("_c"), F.col("_c").alias("_far"))
        now = store(moved.join(jump, "_c").select(order, "_u", "_h", F.col("_far").alias("_c")))


def _one_by_one(rows: DataFrame, order: str) -> DataFrame:
    """``order`` of the rows (order, _u, _h, _c) that are accepted when each component is gone through in order."""
    kind = rows.schema[order].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, seen = None, set()
        for frame in frames:
            kept = []
            for at, u, h, c in zip(frame[order], frame["_u"], frame["_h"], frame["_c"], strict=True):
                if c != component:
                    component, seen = c, set()
                if u not in seen and h not in seen:  # keys of the two kinds differ in their first character
                    seen.update((u, h))
                    kept.append(at)
            yield pd.DataFrame({order: kept})

    sorted_rows = rows.select(order, "_u", "_h", "_c").repartition("_c").sortWithinPartitions("_c", order)
    return sorted_rows.mapInPandas(run, f"`{order}` {kind}")


def admit(batch: DataFrame, stored: DataFrame | None = None, order: str = "seq", component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """Rows of ``batch`` (url, content_hash, unique ``order``) that a one-by-one insert would accept.

    A row is refused if an accepted or stored row has its url or its hash.  Of rows
    with both keys alike only the first can be accepted.  Then rounds accept the rows that
    come first in both their groups and drop those that share a key with them; that
    settles a hot key at once.  Where a round leaves more than half of the rows, as in
    chains of urls and hashes in turn, the connected components of what is left are found
    and each is gone through in order in one task; a component of more than
    ``component_rows`` goes on in rounds.  A null url or hash matches nothing; an empty one does.
    """
    rows = batch
    if stored is not None:
        for key in ("url", "content_hash"):
            rows = rows.join(stored.select(key).distinct(), key, "left_anti")
    rows = store(rows.select(*batch.columns))
    # null keys stand for themselves
    alone = F.concat(F.lit("#"), F.col(order).cast("string"))
    keys = rows.select(order, F.coalesce(F.concat(F.lit("u"), "url"), alone).alias("_u"), F.coalesce(F.concat(F.lit("h"), "content_hash"), alone).alias("_h"))
    undecided = store(keys.groupBy("_u", "_h").agg(F.min(order).alias(order)).select(order, "_u", "_h"))
    parts, left, looked = [], undecided.count(), False
    while left:
        before = left
        won, undecided = _round(undecided, order)
        parts.append(won)
        left = undecided.count()
        if left * 2 > before and not looked:
            looked = True  # what is larger than a task may hold stays in rounds
            whole = components(undecided, order)
            large = store(whole.groupBy("_c").agg(F.count("*").alias("_n")).filter(F.col("_n") > component_rows).select("_c"))
            parts.append(store(_one_by_one(whole.join(large, "_c", "left_anti"), order)))
            undecided = store(whole.join(large, "_c", "left_semi").select(order, "_u", "_h"))
            left = undecided.count()
    if not parts:
        return rows
    accepted = parts[0]
    for p in parts[1:]:
        accepted = accepted.unionByName(p)
    return rows.join(accepted, order, "left_semi").select(*batch.columns)


def get_or_create(batch: DataFrame, stored: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """New rows of ``batch``: the first of each key that isn't stored yet."""
    return first_by(batch, key, order).join(stored.select(key), key, "left_anti").select(*batch.columns)


def top_per(df: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1 as ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
