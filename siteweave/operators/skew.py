"""Joins by keys of which some may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is a hub if more than this share of the rows have it; so there are HUB_SHARE hubs at most.
HUB_SHARE = 256


def hub_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """The inner join of rows (total of them) with values (key, n, more), one row for each key, of which n rows have it.

    The rows of hubs stay where they are, as the few hubs are broadcast; only the rest is dealt by
    key. The result has no n. A null key finds nothing.
    """
    hub = F.col("n") > total // HUB_SHARE
    more = [c for c in values.columns if c not in (key, "n")]
    hubs = F.broadcast(values.where(hub).select(key, *more))
    rest = rows.join(hubs, key, "left_anti").join(values.where(~hub).select(key, *more), key)
    columns = [*rows.columns, *more]
    return rows.join(hubs, key).select(*columns).union(rest.select(*columns))
