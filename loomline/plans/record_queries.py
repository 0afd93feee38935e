"""Search, sorting, dedup, merging, audits and matching over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seasons as S
from ..functions import text as X
from ..operators import listing, prefs
from ..operators import records as R
from . import part_pairs
from .registry import order_of, query, table
from .season_queries import starts

_D = "CAST(o_orderdate AS DATE)"


# Reading

_SEARCH = """SELECT p_partkey, score, place FROM (SELECT p_partkey, score, CAST(row_number() OVER (ORDER BY score DESC, p_size DESC, p_name, p_partkey) AS INTEGER) AS place FROM (
  SELECT *, CASE WHEN p_name = '{0}' THEN 100 WHEN starts_with(p_name, '{0}') THEN 80 WHEN contains(p_name, '{0}') THEN 65 WHEN hits = {1} THEN 45 + hits WHEN hits > 0 THEN hits * 10 END AS score
  FROM (SELECT *, {2} AS hits FROM part)) WHERE score IS NOT NULL) WHERE place <= {3}"""


def _search(spark: SparkSession, sf_dir: str, text: str, limit: int) -> DataFrame:
    key = X.search_key(text)
    found = table(spark, sf_dir, "part").withColumn("score", listing.title_score(F.col("p_name"), key)).where(F.col("score").isNotNull())
    order = [F.col("score").desc(), F.col("p_size").desc(), F.col("p_name"), F.col("p_partkey")]
    top = found.orderBy(*order).limit(listing.search_limit(limit))
    return top.select("p_partkey", "score", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(_SEARCH.format("small ring", 2, "(contains(p_name, 'small')::INTEGER + contains(p_name, 'ring')::INTEGER)", 50))
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, " SMALL  Ring ", 80)


@query(_SEARCH.format("ring", 1, "contains(p_name, 'ring')::INTEGER", 20))
def search_one_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "ring", None)


def _sorted(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rating = F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice"))
        update = listing.update_rank(F.pmod("p_size", F.lit(9)), F.when(F.col("p_partkey") % 2 == 0, F.lit("00:30")), F.lit(S.JAPAN))
        start = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
        keys = listing.mode_order(mode, rating, start, update, F.col("p_name")) + [F.col("p_partkey")]
        w = Window.partitionBy("p_type").orderBy(*keys)
        return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).alias("place"))

    run.__name__ = f"sort_{mode}"
    return run


_UPDATE = "(CASE WHEN p_size % 9 BETWEEN 1 AND 7 THEN CASE WHEN p_partkey % 2 = 0 THEN ((p_size % 9 - 1) * 1440 + 30 - 60 + 10080) % 10080 ELSE (p_size % 9 - 1) * 1440 + 1439 END END)"
for _mode, _key in {
    "ratingAsc": "CASE WHEN p_size % 7 <> 0 THEN p_retailprice END ASC", "ratingDesc": "CASE WHEN p_size % 7 <> 0 THEN p_retailprice END DESC",
    "startDateAsc": "CASE WHEN p_size % 5 <> 0 THEN p_brand END ASC", "startDateDesc": "CASE WHEN p_size % 5 <> 0 THEN p_brand END DESC", "updateTimeAsc": f"{_UPDATE} ASC", "updateTimeDesc": f"{_UPDATE} DESC",
}.items():
    query(f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY {_key} NULLS LAST, p_name, p_partkey) AS INTEGER) AS place FROM part")(_sorted(_mode))


# Audits

_BUCKETS = {"cheap": "o_totalprice < 1000", "urgent": "o_orderpriority = '1-URGENT'", "never": "o_orderkey < 0", "open": "o_orderstatus = 'O'"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS bucket, count(*) FILTER ({c}) AS n, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER ({c}))[1:5], ','), '') AS examples FROM orders" for k, c in _BUCKETS.items()))
def audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.buckets(table(spark, sf_dir, "orders"), {k: F.expr(c) for k, c in _BUCKETS.items()}, "o_orderkey", 5)
    return found.select("bucket", "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("SELECT md5(text) AS key, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS members FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.duplicate_groups(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id")
    return found.select("key", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


# Choosing and merging

@query(f"""SELECT o_custkey, season, o_orderkey FROM (SELECT o_custkey, {order_of(_D)} AS season, o_orderkey, row_number() OVER (PARTITION BY o_custkey, {order_of(_D)} ORDER BY
  CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 20 ELSE 10 END + CASE WHEN o_totalprice > 100000 THEN 5 ELSE 0 END DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def keep_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 20).otherwise(10) + F.when(F.col("o_totalprice") > 100000, 5).otherwise(0)
    rows = starts(spark, sf_dir).withColumn("season", S.primary_order(F.col("start")))
    return R.keep_best(rows, ["o_custkey", "season"], score, "o_orderkey").select("o_custkey", "season", "o_orderkey")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return R.first_by_key(rows, ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, min(event_id) AS place FROM events GROUP BY 1, 2")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return R.last_by_key(rows, ["user_id", "event_type"], "event_id")


_RANKED = "CASE WHEN 'finished' IN (a, b) THEN 'finished' WHEN 'cancelled' IN (a, b) THEN 'cancelled' WHEN 'delayed' IN (a, b) THEN 'delayed' WHEN 'airing' IN (a, b) THEN 'airing' WHEN 'announced' IN (a, b) THEN 'announced' ELSE 'unknown' END"


@query(f"""SELECT a, b, {_RANKED} AS merged, count(*) AS n FROM (SELECT ['finished', 'airing', 'cancelled', 'unknown'][o_orderkey % 4 + 1] AS a, ['delayed', 'announced', 'unknown'][o_custkey % 3 + 1] AS b FROM orders) GROUP BY ALL""")
def status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(pick(("finished", "airing", "cancelled", "unknown"), "o_orderkey").alias("a"), pick(("delayed", "announced", "unknown"), "o_custkey").alias("b"))
    return rows.withColumn("merged", R.merged_status(F.col("a"), F.col("b"))).groupBy("a", "b", "merged").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS (SELECT o_orderkey, {order_of(_D)} AS season, o_totalprice FROM orders), old AS (SELECT *, 'old' AS side FROM x), new AS (SELECT o_orderkey, season, o_totalprice * 2 AS o_totalprice, 'new' AS side FROM x WHERE season = 23980 AND o_totalprice > 50000)
SELECT * FROM old WHERE season <> 23980 AND o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new""")
def season_partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = starts(spark, sf_dir).select("o_orderkey", S.primary_order(F.col("start")).alias("season"), "o_totalprice")
    old, new = rows.withColumn("side", F.lit("old")), rows.where("season = 23980 and o_totalprice > 50000").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "side": F.lit("new")})
    return R.replace_partition(old, new, "o_orderkey", F.col("season") == 23980)


_WORDS = "list_distinct(string_split(p_name, ' '))"


@query(f"""WITH w AS (SELECT p_partkey, p_size, p_brand, unnest({_WORDS}) AS k FROM part)
SELECT l.p_partkey, min(r.p_partkey) AS match FROM w l JOIN w r ON l.k = r.k AND l.p_size = r.p_size AND l.p_brand <> r.p_brand GROUP BY 1""")
def title_overlap_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, the first of another brand that has its size and shares a word of its name."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.split("p_name", " ").alias("words"))
    return R.first_of_another(rows, "p_partkey", "words", "p_size", "p_brand")


@query("""SELECT c_custkey, coalesce(s.s_name, f.s_name) AS found, s.s_name IS NOT NULL AS by_id FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey
LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) f ON f.s_nationkey = c_nationkey""")
def two_tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, else the first by another key."""
    supplier = table(spark, sf_dir, "supplier")
    first = supplier.groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("fallback"))
    by_id = supplier.select("s_suppkey", "s_name")
    both = table(spark, sf_dir, "customer").join(by_id, F.col("c_custkey") == F.col("s_suppkey"), "left").join(first, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return both.select("c_custkey", F.coalesce("s_name", "fallback").alias("found"), F.col("s_name").isNotNull().alias("by_id"))


@query("""SELECT o_orderkey, side FROM (SELECT o_orderkey, 'first' AS side FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' UNION ALL
SELECT o_orderkey, 'second' FROM orders WHERE o_orderpriority = '2-HIGH' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'))""")
def drop_secondary_if_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second source count only if there is none of the first: one flag for all."""
    orders = table(spark, sf_dir, "orders")
    first = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_orderkey", F.lit("first").alias("side"))
    second = orders.where("o_orderpriority = '2-HIGH'").select("o_orderkey", F.lit("second").alias("side"))
    return first.unionByName(second.where(F.lit(first.isEmpty())))


# Windows over events

@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n FROM events")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", R.rolling_count(None, "user_id", millis, 3_600_000).alias("n"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", R.carried(known, "user_id", ["ts", "event_id"]).alias("carried"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS types, list_distinct(list(event_type) FILTER (value > 95)) AS done, list_distinct(list(event_type) FILTER (value < 10)) AS low FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_filter(types, lambda x: NOT list_contains(coalesce(low, []), x))), ',') AS followed,
array_to_string(list_sort(list_filter(types, lambda x: NOT list_contains(coalesce(done, []), x) AND (list_contains(coalesce(low, []), x) OR x <> 'view'))), ',') AS watching, array_to_string(list_sort(coalesce(done, [])), ',') AS completed FROM u""")
def prefs_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of event types by user; 'view' runs, and what a user has small values of is finished."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set("event_type").alias("types"), F.collect_set(F.when(F.col("value") > 95, F.col("event_type"))).alias("done"), F.collect_set(F.when(F.col("value") < 10, F.col("event_type"))).alias("low"))
    lists = prefs.consistent(F.col("types"), F.col("types"), F.col("done"))
    kept = prefs.reconciled(lists, F.array_union("low", F.array(F.lit("view"))), F.col("low"))
    return u.select("user_id", *(F.array_join(kept[c], ",").alias(c) for c in ("followed", "watching", "completed")))


# Matching

_PAIRS = """SELECT a.p_partkey AS item, b.p_partkey AS candidate, CAST(greatest(0, least(100, CASE WHEN a.p_name = b.p_name THEN 45 WHEN 1.0::DOUBLE - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) >= 0.6
  THEN floor(20 + 12 * (1.0::DOUBLE - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name))) + 0.5::DOUBLE) ELSE 0 END
  + CASE WHEN abs(a.p_retailprice - b.p_retailprice) <= 10 THEN 20 WHEN abs(a.p_retailprice - b.p_retailprice) <= 100 THEN 16 WHEN abs(a.p_retailprice - b.p_retailprice) > 500 THEN -18 ELSE 0 END
  + CASE WHEN a.p_type = b.p_type THEN 13 ELSE -7 END + 20)) AS INTEGER) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey"""


@query(_PAIRS)
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_pairs.scored(spark, sf_dir)


_RANKS = f"SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, candidate) AS rank, coalesce(score - lead(score) OVER (PARTITION BY item ORDER BY score DESC, candidate), 100) AS lead FROM ({_PAIRS})"


@query(f"SELECT item, candidate, score, CAST(lead AS INTEGER) AS lead, score >= 74 OR (score >= 66 AND lead >= 25) AS accepted FROM ({_RANKS}) WHERE rank = 1")
def match_top1_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = part_pairs.best(spark, sf_dir)
    return best.select("item", "candidate", "score", "lead", ((F.col("score") >= 74) | ((F.col("score") >= 66) & (F.col("lead") >= 25))).alias("accepted"))


_PENALTY = "greatest(0, score - CASE WHEN lead < 5 THEN 20 WHEN lead < 12 THEN 10 ELSE 0 END)"


@query(f"""SELECT item, candidate, CAST({_PENALTY} AS INTEGER) AS score, CASE WHEN {_PENALTY} >= 85 AND lead >= 12 THEN 'high' WHEN {_PENALTY} >= 65 THEN 'medium' ELSE 'low' END AS confidence, CAST(rank AS INTEGER) AS rank FROM ({_RANKS})""")
def match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate loses points if the next one is close; ranks stay."""
    ranked = part_pairs.ranked(spark, sf_dir)
    score = F.greatest(F.lit(0), F.col("score") - F.when(F.col("lead") < 5, 20).when(F.col("lead") < 12, 10).otherwise(0))
    confidence = F.when((score >= 85) & (F.col("lead") >= 12), F.lit("high")).when(score >= 65, F.lit("medium")).otherwise(F.lit("low"))
    return ranked.select("item", "candidate", score.cast("int").alias("score"), confidence.alias("confidence"), "rank")
