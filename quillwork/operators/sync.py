"""Incremental push of articles to a search index (batch parts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsynced_articles(articles: DataFrame, force: bool = False) -> DataFrame:
    """Articles not yet in the index; all with force."""
    return articles if force else articles.where("synced IS NULL")


def sync_backlog(articles: DataFrame) -> DataFrame:
    """One row: how many wait and how many are in the index."""
    return articles.agg(F.count_if(F.col("synced").isNull()).alias("pending"), F.count_if(F.col("synced").isNotNull()).alias("synced"))


def sync_stamp(articles: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """The articles as a sync leaves them: those that it pushed are synced, at `now`; others keep their stamp, if they carry one."""
    pushed = F.lit(True) if force else F.col("synced").isNull()
    before = F.col("synced_at") if "synced_at" in articles.columns else F.lit(None).cast("timestamp_ntz")
    return articles.withColumns({"synced_at": F.when(pushed, now).otherwise(before), "synced": F.when(pushed, F.lit(True)).otherwise(F.col("synced"))})


def merged_index(index: DataFrame, records: DataFrame) -> DataFrame:
    """The index with new records put in by id: what is new replaces what was there."""
    return records.unionByName(index.join(records.select("id"), "id", "left_anti"))
