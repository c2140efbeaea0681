"""What differs between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, columns): keys that were added, removed or changed, and which columns changed.

    Only keys and a digest per column are shuffled. Rows that share a key are compared as
    a whole, whatever their order; their number is the column ``*``. Null keys are equal
    to each other, as are null values. Columns of one side alone count as changed where
    they aren't null. What is the same has no row.
    """
    columns = sorted((set(before.columns) | set(after.columns)) - set(keys))

    def digests(df: DataFrame, side: str) -> DataFrame:
        values = [F.col(c) if c in df.columns else F.lit(None) for c in columns]
        sums = [F.sum(F.when(v.isNotNull(), F.xxhash64(v)).otherwise(0).cast("decimal(38,0)")) for v in values]
        return df.groupBy(*keys).agg(F.array(F.count(F.lit(1)).cast("decimal(38,0)"), *sums).alias(side))

    old, new = digests(before, "_before"), digests(after, "_after")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    joined = old.alias("b").join(new.alias("a"), on, "full")
    named = [F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys]
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed")
    names = F.array(F.lit("*"), *(F.lit(c) for c in columns))
    unlike = F.filter(F.zip_with(F.zip_with("_before", "_after", lambda x, y: x != y), names, lambda d, n: F.when(d, n)), lambda n: n.isNotNull())
    rows = joined.select(*named, change.alias("change"), F.when(F.col("_before").isNotNull() & F.col("_after").isNotNull(), unlike).otherwise(F.array().cast("array<string>")).alias("columns"))
    return rows.where((F.col("change") != "changed") | (F.size("columns") > 0))
