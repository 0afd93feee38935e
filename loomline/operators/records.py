"""Choosing, merging and replacing records: joins, aggregations and windows on any columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seasons import yes

#: Of two states the one further left wins.
STATUS_RANK = ("finished", "cancelled", "delayed", "airing", "announced")


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; combined before the shuffle, so a common key is no burden."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in others))


def last_by_key(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The last row of each key, with the place where the key came up first (column ``place``)."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), ordinal).alias("_best"), F.min(ordinal).alias("place"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in others), "place")


def keep_best(rows: DataFrame, keys: Sequence[str], score: Column, tie: str) -> DataFrame:
    """The row of each key with the highest score, the smallest tie of equal ones."""
    return first_by_key(rows, keys, [(-score).alias("_score"), F.col(tie).alias("_tie")])


def merged_status(left: Column, right: Column) -> Column:
    """The stronger of two states; unknown is the weakest."""
    out = F.lit("unknown")
    for status in reversed(STATUS_RANK):
        out = F.when(yes(left == status) | yes(right == status), F.lit(status)).otherwise(out)
    return out


def first_known(left: Column, right: Column) -> Column:
    """Left unless it is null: an empty text counts as known."""
    return F.coalesce(left, right)


def replace_partition(old: DataFrame, new: DataFrame, key: str, partition: Column) -> DataFrame:
    """``old`` without the rows of a partition and without those that ``new`` has, and all of ``new``."""
    return old.where(~yes(partition)).join(new.select(key), key, "left_anti").unionByName(new)


def first_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: str, right_order: str, condition: Column | None = None) -> DataFrame:
    """For each left row, the first right row (by order) that shares one of its keys: left_id, right_id.

    ``keys`` is an array in both; arrays are exploded and joined on equal keys,
    so nothing is compared that shares none.
    """
    a = left.withColumn("_k", F.explode(F.array_distinct(keys))).alias("l")
    b = right.withColumn("_k", F.explode(F.array_distinct(keys))).alias("r")
    on = F.col("l._k") == F.col("r._k")
    pairs = a.join(b, on if condition is None else on & condition)
    return pairs.groupBy(F.col(f"l.{left_id}").alias(left_id)).agg(F.min_by(F.col(f"r.{right_id}"), F.col(f"r.{right_order}")).alias("match"))


def first_of_another(rows: DataFrame, row_id: str, keys: str, same: str, differs: str) -> DataFrame:
    """For each row, the first other row (by id) that shares one of its keys and ``same``, but not ``differs``: row_id, match.

    Of each key only two rows can be such a first one: the first of all, and the
    first of those that differ from it.  Both come from aggregations, so no
    pairs are made.
    """
    one = rows.where(F.col(same).isNotNull() & F.col(differs).isNotNull()).select(row_id, same, differs, F.explode(F.array_distinct(keys)).alias("_k")).where(F.col("_k").isNotNull())
    sides = one.groupBy("_k", same, differs).agg(F.min(row_id).alias("_id"))
    first = sides.groupBy("_k", same).agg(F.min(F.struct(F.col("_id"), F.col(differs).alias("_side"))).alias("_first"))
    firsts = sides.join(first, ["_k", same]).groupBy("_k", same, "_first").agg(F.min(F.when(F.col("_first._side") != F.col(differs), F.col("_id"))).alias("_second"))
    met = one.join(firsts, ["_k", same]).select(row_id, F.when(F.col("_first._side") != F.col(differs), F.col("_first._id")).otherwise(F.col("_second")).alias("_match"))
    return met.where(F.col("_match").isNotNull()).groupBy(row_id).agg(F.min("_match").alias("match"))


def duplicate_groups(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """Keys that more than one row has: key, n, members in order."""
    found = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
    return found.where("n > 1")


def margins(scored: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Rank of each candidate and its lead on the next (100 for the last): rank, lead."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("lead", F.coalesce(F.col(score) - F.lead(score).over(w), F.lit(100)))


def numbered(rows: DataFrame, leading: Sequence[str], last: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in order of the leading columns (nulls last), then of the last keys.

    Groups of equal leading values are counted, the counts summed up in order,
    and each group numbers its own rows from there: no task sorts all rows,
    only one the groups.
    """
    groups = rows.groupBy(*leading).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*(F.col(c).asc_nulls_last() for c in leading)).rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(*(F.col(c).alias(f"_group_{c}") for c in leading), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*leading).orderBy(*last)))
    same = [F.col(c).eqNullSafe(F.col(f"_group_{c}")) for c in leading]
    return own.join(starts, same).withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)


def rolling_count(rows: DataFrame, key: str, millis: Column, window: int = 60_000) -> Column:
    """Rows of a key in the window that ends with the row."""
    return F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(millis).rangeBetween(1 - window, 0))


def carried(value: Column, key: str, order: Sequence[Column | str]) -> Column:
    """The last known value up to a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def buckets(rows: DataFrame, tests: dict[str, Column], key: str, examples: int = 40) -> DataFrame:
    """For each test: bucket, n and the first keys that pass it, in one pass."""
    one = [F.struct(F.lit(name).alias("bucket"), yes(test).alias("hit")) for name, test in tests.items()]
    long = rows.select(F.col(key).alias("_key"), F.inline(F.array(*one))).groupBy("bucket").agg(
        F.count_if("hit").alias("n"), F.min(F.when(F.col("hit"), F.col("_key"))).alias("_first"),
    )
    firsts = rows.select(F.col(key).alias("_key"), F.inline(F.array(*one))).where("hit")
    ranked = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy("_key"))).where(F.col("_r") <= examples)
    listed = ranked.groupBy("bucket").agg(F.array_sort(F.collect_list("_key")).alias("examples"))
    return long.drop("_first").join(listed, "bucket", "left").withColumn("examples", F.coalesce("examples", F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>")))


def bag_values(bag: Column, keys: Sequence[str]) -> Column:
    """Trimmed distinct values of a bag of (key, values) facts whose key is one of the given, in order."""
    chosen = F.filter(bag, lambda e: yes(F.lower(e["key"]).isin(*[k.lower() for k in keys])))
    return F.filter(F.array_distinct(F.flatten(F.transform(chosen, lambda e: F.transform(e["values"], lambda v: F.trim(v))))), lambda v: F.length(v) > 0)
