"""Joins and groupings in which one key may hold a large part of all rows.

Grouped aggregates combine before they shuffle, so a hot key is no trouble
there.  A join that an aggregate on the same keys follows is: adaptive execution
will not split its partitions, because the aggregate relies on them.  Such joins
salt their hot keys here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"

# A key is hot from so many rows on as one task takes easily, whatever its share
# of all rows.  The sketch names the MOST largest keys at most.
HOT_ROWS = 1_000_000
MOST = 1_000
SALTS = 64
_TRACKED = 20_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> Column:
    """Hashes of the hot keys, as a scalar subquery of at most `MOST` entries.

    A sketch finds them in one pass without a shuffle by key.  Its error cannot
    harm a result: any choice of salted keys gives the same join.
    """
    return (
        df.select(F.xxhash64(*keys).alias("_key"))
        .agg(F.expr(f"approx_top_k(_key, {MOST}, {_TRACKED})").alias("_top"))
        .select(
            F.transform(
                F.filter("_top", lambda entry: entry["count"] >= hot_rows), lambda entry: entry["item"]
            )
        )
        .scalar()
    )


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `rows` to `lookup` on `keys`, hot keys being spread by a hash of `spread`.

    `spread` must be columns of the row itself, so that a recomputed task salts
    its rows as before.  The result keeps the salt: group by the keys and the
    salt first, then by the keys alone.
    """
    hot = hot_keys(rows, keys, hot_rows)
    is_hot = F.coalesce(F.array_contains(hot, F.xxhash64(*keys)), F.lit(False))
    salted = rows.withColumn(
        SALT, F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    every_salt = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copies = F.when(is_hot, every_salt).otherwise(F.array(F.lit(0)))
    return salted.join(lookup.withColumn(SALT, F.explode(copies)), [*keys, SALT], how)
