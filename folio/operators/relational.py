"""Patterns over groups: keep first, top k, samples, splits, caps, guards, counts.

Random order is the order of ``md5(id-seed)``: the same on every run and in every
engine, and free of any driver-side generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def shuffled(key: str, seed: str = "0") -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ascending order, nulls first; equal rows in the order leave one of them.

    Strings are grouped by their SHA-256, and each task keeps one row per key before
    the shuffle, so a key that many rows share costs one row a task. Null keys are one group.
    """
    of = [F.sha2(k, 256) if isinstance(df.schema[k].dataType, StringType) else F.col(k) for k in keys]
    by = df.groupBy(*(c.alias(f"_k{n}") for n, c in enumerate(of)))
    return by.agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")).select("_first.*")


def top_per_group(df: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def sample_per_group(df: DataFrame, groups: list[str], key: str, n: int, seed: str = "0") -> DataFrame:
    return top_per_group(df, groups, [shuffled(key, seed), F.col(key)], n)


#: Leading hexadecimal digits of the shuffling hash that cut a group into parts: 256 of them.
PART_DIGITS = 2


def shuffled_ranks(df: DataFrame, groups: list[str], key: str, seed: str, amounts: list[str] | None = None) -> DataFrame:
    """Add ``_place`` (from 1) and ``_n``, place and size in the shuffled group, and ``_run_<amount>``, running sums.

    A group is cut by the first digits of its hash, each part is ranked on its own and
    set behind the counts of the parts before it, so no task ranks a whole group. The
    counts are at most 256 rows a group. Null groups are groups of their own; rows with a
    null key are shuffled by their other columns.
    """
    amounts = amounts or []
    other = F.md5(F.concat(F.xxhash64(*df.columns).cast("string"), F.lit(f"-{seed}")))
    cut = df.withColumn("_h", F.coalesce(shuffled(key, seed), other)).withColumn("_part", F.substring("_h", 1, PART_DIGITS))
    names = [f"_g{k}" for k in range(len(groups))]
    parts = cut.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_c"), *(F.coalesce(F.sum(a), F.lit(0)).alias(f"_s_{a}") for a in amounts))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*groups)).alias("_n"), *(F.coalesce(F.sum(f"_s_{a}").over(before), F.lit(0)).alias(f"_o_{a}") for a in amounts))
    on = F.col("_part") == F.col("_p")
    for g, n in zip(groups, names, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(n))
    within = Window.partitionBy(*groups, "_part").orderBy("_h", key)
    run = within.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, on).withColumn("_place", F.col("_before") + F.row_number().over(within))
    for a in amounts:
        out = out.withColumn(f"_run_{a}", F.col(f"_o_{a}") + F.coalesce(F.sum(a).over(run), F.lit(0)))
    return out.drop("_h", "_part", "_p", "_before", *names, *(f"_o_{a}" for a in amounts))


def add_splits(df: DataFrame, groups: list[str], key: str, train: float = 0.7, val: float = 0.15, seed: str = "split", guarantee: bool = False) -> DataFrame:
    """Stratified train, val and test by place in a shuffled group.

    With ``guarantee``, a group of three or more has at least one of val and test.
    """
    n = F.col("_n")
    n_val, n_train = F.floor(n * F.lit(val)), F.floor(n * F.lit(train))
    if guarantee:
        n_val = F.when(n >= 3, F.greatest(n_val, F.lit(1))).otherwise(n_val)
        n_train = F.when(n >= 3, F.least(n_train, n - n_val - 1)).otherwise(n_train)
    place = F.col("_place")
    ranked = shuffled_ranks(df, groups, key, seed)
    return ranked.withColumn("split", F.when(place <= n_train, "train").when(place <= n_train + n_val, "val").otherwise("test")).drop("_place", "_n")


def running_cap(df: DataFrame, groups: list[str], key: str, size: str, cap: int, seed: str = "cap") -> DataFrame:
    """Whole items of a shuffled group while their running size stays within the cap; a null size counts as 0."""
    return shuffled_ranks(df, groups, key, seed, [size]).where(F.col(f"_run_{size}") <= cap).drop(f"_run_{size}", "_place", "_n")


def item_splits(df: DataFrame, item: str, group: str, train: float = 0.7, val: float = 0.15, seed: str = "split") -> DataFrame:
    """Splits of rows by their item, so that no item's rows are in two of them; ``group`` is an item's stratum."""
    items = df.groupBy(item).agg(F.min(group).alias("_stratum"))
    split = add_splits(items, ["_stratum"], item, train, val, seed).select(item, "split")
    return df.join(split, item)


def cap_groups(df: DataFrame, group: str, key: str, cap: int, seed: str = "cap") -> DataFrame:
    """At most ``cap`` rows of each group, chosen at random; groups below it stay whole."""
    return shuffled_ranks(df, [group], key, seed).where(F.col("_place") <= cap).drop("_place", "_n")


def inject(train: DataFrame, test: DataFrame, pool: DataFrame, key: str, share: float = 0.2, seed: str = "inject") -> DataFrame:
    """The test rows and as many of the pool as make ``share`` of the test target, none of them in train or test.

    The number is one count; the rows are the first of the shuffled pool.
    """
    want = int(round(test.count() * share))
    fresh = without(pool, [train.select(key), test.select(key)], key)
    return test.unionByName(fresh.orderBy(shuffled(key, seed), key).limit(want))


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts, ties by value; nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def join_by_id(left: DataFrame, right: DataFrame, key: str, normalise, suffix: str = "_right") -> DataFrame:
    """Inner join on the normalised id; columns that both have get a suffix on the right."""
    other = right.select(normalise(F.col(key)).alias("_id"), *(F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key))
    return left.withColumn("_id", normalise(F.col(key))).join(other, "_id").drop("_id")


def flagged(df: DataFrame, key: str, marks: DataFrame, name: str) -> DataFrame:
    """Add ``name``: is the row's key among those of ``marks``? Keys that are missing there are false."""
    seen = marks.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(seen, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among those of ``wanted``, as a semi-join."""
    return df.join(wanted.select(key), key, "left_semi")


def round_robin(df: DataFrame, groups: list[str], lane: str, key: str, cap: int, seed: str = "rr", priority: list[str] | None = None) -> DataFrame:
    """Up to cap rows per group, taken in turn from its lanes.

    In each turn the lanes of ``priority`` come first, in its order, then others by name.
    No lane can give more than cap rows, so longer ones are cut before a group is ranked.
    """
    within = Window.partitionBy(*groups, lane).orderBy(shuffled(key, seed), key)
    at = F.array_position(F.array(*(F.lit(x) for x in priority or [])).cast("array<string>"), F.col(lane).cast("string"))
    first = F.when(at > 0, at).otherwise(len(priority or []) + 1)
    turn = Window.partitionBy(*groups).orderBy("_turn", first, lane)
    cut = df.withColumn("_turn", F.row_number().over(within)).where(F.col("_turn") <= cap)
    return cut.withColumn("_rn", F.row_number().over(turn)).where(F.col("_rn") <= cap).drop("_turn", "_rn")


def members(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members): the distinct members of each group, sorted; null members are left out, a null group is a group.

    Pairs are made distinct before a group is gathered, which then holds each member once.
    """
    pairs = df.select(group, member).distinct()
    return pairs.groupBy(group).agg(F.sort_array(F.collect_list(member)).alias("members"))


def min_support(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with at least so many; null groups go. Groups are counted before rows meet them."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(group)
    return df.join(counts, group, "left_semi")


def without(df: DataFrame, keys: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the tables (a leakage guard)."""
    seen = keys[0].select(key)
    for k in keys[1:]:
        seen = seen.union(k.select(key))
    return df.join(seen.distinct(), key, "left_anti")


def running_sums(df: DataFrame, order: str, amounts: list[str], keys: list[str] | None = None, descending: bool = False, buckets: int = 256) -> DataFrame:
    """Add ``run_<amount>``: inclusive running sums in the order of a column, by itself within each group of ``keys``.

    Values are cut at approximate quantiles, of each group its own; a bucket runs by
    itself, behind the totals of those before it (at most ``buckets`` rows a group), so
    neither a hot group nor an outlier puts all rows in one task. The sums are exact
    wherever the cuts lie. Null keys are a group, null values come first in ascending
    order and last in descending. Rows of equal order must be merged beforehand.
    """
    keys = keys or []
    names = [f"_k{n}" for n in range(len(keys))]
    cut = bucketed(df, order, keys, buckets)
    before = Window.partitionBy(*names).orderBy(F.desc("_p") if descending else F.asc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_b").alias("_p")).agg(*(F.sum(a).alias(a) for a in amounts))
    offsets = totals.select(*names, "_p", *(F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_o_{a}") for a in amounts))
    run = Window.partitionBy(*keys, "_b").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined_null_safe(cut, offsets, [*keys, "_b"], [*names, "_p"])
    return out.select(*df.columns, *((F.col(f"_o_{a}") + F.coalesce(F.sum(a).over(run), F.lit(0))).alias(f"run_{a}") for a in amounts))


def bucketed(df: DataFrame, order: str, keys: list[str], buckets: int) -> DataFrame:
    """Add ``_b``, how many of the approximate quantiles of its group a value lies above; 0 for nulls.

    Equal values share a bucket.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    cuts = F.percentile_approx(order, [n / buckets for n in range(1, buckets)], 10 * buckets)
    if keys:
        edges = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(cuts.alias("_edges"))
        known = _joined_null_safe(df, edges, keys, names)
    else:
        found = df.agg(cuts).first()[0] or []
        known = df.withColumn("_edges", F.array(*(F.lit(e) for e in found)).cast(ArrayType(df.schema[order].dataType)))
    place = F.when(F.col(order).isNull() | F.col("_edges").isNull(), 0).otherwise(F.size(F.filter("_edges", lambda e: e < F.col(order))))
    return known.withColumn("_b", place).drop("_edges")


def _joined_null_safe(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Inner join of ``keys`` with ``names``, which go; nulls meet nulls."""
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, on).drop(*names)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares, most frequent first, ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, rows: str, column: str, values: list) -> DataFrame:
    """Counts of row by column value, zero where there are none."""
    return df.groupBy(rows).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def ordered_concat(text: str, order: str) -> Column:
    """Aggregate: texts joined by spaces in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")


#: How far the cap is relaxed, in multiples of the wished share and then as plain shares.
RELAXED, PLAIN_SHARES = (1.0, 1.5, 2.0), (0.5, 0.75, 1.0)


def quotas(supply: DataFrame, level: str, group: str, n: str, target: int | Column, max_share: float) -> DataFrame:
    """(level, group, quota): an even spread of a target over the groups of each level, none above its supply or the cap.

    ``supply`` has a row per level and group. The cap is a share of the target and is
    relaxed in steps until the supplies below it meet the target; a target above all
    supplies is cut to them. Groups share equally: those that have less give all, the
    others stand at one water level, and what is left over goes one each to the first
    by name. Nulls and groups without supply get none; a level that gets none is absent.

    The water level is found from the histogram of limits, at most as many rows a level
    as it has distinct supplies; a level's groups are ranked once, by name.
    """
    rows = supply.where(F.col(level).isNotNull() & F.col(group).isNotNull() & (F.col(n) > 0))
    rows = rows.select(F.col(level).alias("_lv"), F.col(group).alias("_g"), F.col(n).cast("long").alias("_s"), F.lit(target).cast("long").alias("_t"))
    whole = rows.groupBy("_lv").agg(F.least(F.max("_t"), F.sum("_s")).alias("_want")).where(F.col("_want") > 0)
    shares = F.array(*(F.lit(float(min(1.0, k * max_share))) for k in RELAXED), *(F.lit(k) for k in PLAIN_SHARES))
    caps = whole.select("_lv", "_want", F.posexplode(F.transform(shares, lambda x: F.greatest(F.lit(1), F.floor(F.col("_want") * x)).cast("long"))).alias("_step", "_cap"))
    counts = rows.groupBy("_lv", "_s").agg(F.count(F.lit(1)).alias("_n"))
    limits = counts.join(caps, "_lv").groupBy("_lv", "_step", "_want", "_cap", F.least("_s", "_cap").alias("_limit")).agg(F.sum("_n").alias("_n"))
    enough = limits.groupBy("_lv", "_step").agg(F.sum(F.col("_limit") * F.col("_n")).alias("_all"), F.max("_want").alias("_w")).where(F.col("_all") >= F.col("_w"))
    limits = limits.join(enough.groupBy("_lv").agg(F.min("_step").alias("_step")), ["_lv", "_step"], "left_semi")

    below = Window.partitionBy("_lv").orderBy("_limit").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("_lv").orderBy("_limit").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    given = F.coalesce(F.sum(F.col("_limit") * F.col("_n")).over(below), F.lit(0))
    steps = limits.select("*", given.alias("_given"), F.sum("_n").over(above).alias("_live"))
    steps = steps.withColumn("_water", F.floor((F.col("_want") - F.col("_given")) / F.col("_live")))
    # the first limit that stands above what an even share would give
    short = F.col("_limit") > F.col("_water")
    water = steps.groupBy("_lv").agg(F.max("_cap").alias("_cap"), F.min(F.when(short, F.struct("_limit", "_water", (F.col("_want") - F.col("_given") - F.col("_water") * F.col("_live")).alias("_over")))).alias("_at"))
    known = rows.join(water, "_lv").withColumn("_limit", F.least("_s", "_cap")).withColumn("_open", F.coalesce(F.col("_limit") > F.col("_at._water"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("_lv", "_open").orderBy("_g"))
    quota = F.when(F.col("_open"), F.col("_at._water") + (rank <= F.col("_at._over")).cast("long")).otherwise(F.col("_limit"))
    return known.select(F.col("_lv").alias(level), F.col("_g").alias(group), quota.cast("long").alias("quota")).where("quota > 0")


def _within_quota(df: DataFrame, level: str, group: str, key: str, quota: DataFrame, seed: str) -> DataFrame:
    ranked = shuffled_ranks(df.where(F.col(level).isNotNull() & F.col(group).isNotNull()), [level, group], key, seed)
    return ranked.join(quota.withColumnRenamed("quota", "_q"), [level, group]).where(F.col("_place") <= F.col("_q")).select(*df.columns)


def sample_to_quota(df: DataFrame, group: str, key: str, target: int, max_share: float, seed: str = "quota") -> DataFrame:
    """A shuffled sample that meets the quota of every category; rows without a category are in none."""
    all_rows = df.withColumn("_level", F.lit(0))
    supply = all_rows.groupBy("_level", group).agg(F.count(F.lit(1)).alias("_supply"))
    return _within_quota(all_rows, "_level", group, key, quotas(supply, "_level", group, "_supply", target, max_share), seed).drop("_level")


def quota_per_level(df: DataFrame, level: str, group: str, key: str, target: int, max_share: float, seed: str = "quota") -> DataFrame:
    """A sample that spreads target evenly over levels (years, for instance) and, in each, over groups by quota.

    Supplies are counted once; what a level cannot give is not made up for by others. A
    level has at least one row as its target.
    """
    supply = df.where(F.col(level).isNotNull() & F.col(group).isNotNull()).groupBy(level, group).agg(F.count(F.lit(1)).alias("_supply"))
    levels = supply.agg(F.count_distinct(level)).first()[0]
    return _within_quota(df, level, group, key, quotas(supply, level, group, "_supply", max(1, target // max(levels, 1)), max_share), seed)
