"""Deep pages: the rows of offset and limit, found by counts of ranges."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillwork.operators import corpus, pages

KINDS = "id long, status string, at timestamp_ntz, price decimal(10,2), score double"


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, None if k % 11 == 0 else f"s{k % 3}", None if k % 7 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=k * 37 % 100), None if k % 5 == 0 else Decimal(k % 13), float(k * 7 % 10)) for k in range(1000)]
    return spark.createDataFrame(made, KINDS).repartition(5).persist()


@pytest.mark.parametrize("order", [["id"], ["id desc"], ["status", "at", "id"], ["status desc", "at desc", "id"], ["price", "score desc", "id desc"], ["at", "id"]])
def test_same_rows_as_offset_and_limit(rows, order):
    whole = [r.id for r in rows.orderBy(*pages.ordering(order)).select("id").collect()]
    for page, size, ranges in ((1, 7, 8), (50, 7, 8), (142, 7, 8), (143, 7, 64), (144, 7, 8), (3, 300, 16), (9, 100, 2), (0, 5, 4)):
        got = [r.id for r in pages.deep_page(rows, order, page, size, ranges).collect()]
        first = (max(1, page) - 1) * size
        assert got == whole[first : first + size], (page, size, ranges)


def test_empty_and_repeated_rows(spark, rows):
    assert pages.deep_page(rows.limit(0), ["id"], 3, 5).count() == 0
    same = spark.createDataFrame([(1, "s", None, None, 0.0)] * 50, KINDS)
    assert pages.deep_page(same, ["status", "id"], 3, 20, 8).count() == 10


def test_only_one_range_is_sorted(rows, monkeypatch):
    """The rows that reach the sort are about one range; pages below DEEP keep their plan."""
    page = pages.deep_page(rows, ["status", "at", "id"], 60, 10, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    bounds = pages.bounds_of(rows, ["status", "at", "id"], 20)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    counts = list(rows.agg(*[F.count_if(pages.before(b, ["status", "at", "id"], kinds)) for b in bounds]).first())
    assert counts == sorted(counts) and max(b - a for a, b in zip([0, *counts], [*counts, 1000])) <= 150
    monkeypatch.setattr(corpus, "DEEP", 500)
    deep, flat = (corpus.page_of(rows, ["id"], n, 10) for n in (51, 50))
    assert [r.id for r in deep.collect()] == list(range(500, 510)) and [r.id for r in flat.collect()] == list(range(490, 500))
    assert "Filter" in deep._jdf.queryExecution().optimizedPlan().toString() and "Filter" not in flat._jdf.queryExecution().optimizedPlan().toString()
