"""Pages deep in an order, without sorting what lies before them.

A bounded sample of the order's keys, chosen by hash, gives range bounds; one
pass counts the rows before each bound; only the rows between the two bounds
around the page are sorted. The result is that of order, offset and limit.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Keys sampled, and ranges that they bound.
SAMPLE, RANGES = 4096, 64
#: Offsets from here on are found by ranges.
DEEP = 10_000


def _key(name: str) -> tuple[str, bool]:
    """('created_at desc') -> its column and whether it descends."""
    column, _, way = name.partition(" ")
    return column, way.lower() == "desc"


def ordering(order: list[str]) -> list[Column]:
    """Ascending with nulls first, descending with nulls last, as Spark orders."""
    return [F.desc(c) if down else F.asc(c) for c, down in map(_key, order)]


def _literal(value: object, kind: str) -> Column:
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value).cast(kind)


def before(bound: Row, order: list[str], kinds: dict[str, str]) -> Column:
    """Whether a row stands before the bound in the order."""
    options, same = [], F.lit(True)
    for name, down in map(_key, order):
        column, value = F.col(name), bound[name]
        if value is None:
            earlier = column.isNotNull() if down else F.lit(False)
        else:
            limit = _literal(value, kinds[name])
            earlier = F.coalesce(column > limit, F.lit(False)) if down else F.coalesce(column < limit, F.lit(True))
        options.append(same & earlier)
        same = same & column.eqNullSafe(_literal(value, kinds[name]))
    return reduce(lambda a, b: a | b, options)


def bounds_of(rows: DataFrame, order: list[str], ranges: int = RANGES, sample: int = SAMPLE) -> list[Row]:
    """At most ranges - 1 different keys that cut the rows into parts of about the same size."""
    names = [c for c, _ in map(_key, order)]
    chosen = rows.select(*names).orderBy(F.xxhash64(*names)).limit(sample)
    keys = chosen.orderBy(*ordering(order)).collect()  # at most `sample` keys
    cut = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    return [b for k, b in enumerate(cut) if k == 0 or b != cut[k - 1]]


def deep_page(rows: DataFrame, order: list[str], page: int, per_page: int, ranges: int = RANGES) -> DataFrame:
    """The rows of a page of `order` (column names, with ' desc' where it descends, ending with a unique one)."""
    offset = (max(1, page) - 1) * per_page
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    bounds = bounds_of(rows, order, ranges)
    counts = list(rows.agg(*[F.count_if(before(b, order, kinds)).alias(f"n{k}") for k, b in enumerate(bounds)]).first()) if bounds else []
    low = max((k for k, n in enumerate(counts) if n <= offset), default=None)
    high = min((k for k, n in enumerate(counts) if n >= offset + per_page), default=None)
    some = rows
    if low is not None:
        some = some.where(~before(bounds[low], order, kinds))
    if high is not None:
        some = some.where(before(bounds[high], order, kinds))
    return some.orderBy(*ordering(order)).offset(offset - (counts[low] if low is not None else 0)).limit(per_page)
