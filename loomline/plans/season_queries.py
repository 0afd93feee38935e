"""Seasons, slots and lifecycles over orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seasons as S
from ..operators import records as R
from .registry import calendar_order, order_of, quarter_of, query, table, year_of

#: The instant that the queries take for now, and the season asked for.
NOW = "2000-06-15T03:00:00"
ASKED_YEAR, ASKED_QUARTER = 1998, "spring"
ASKED = ASKED_YEAR * 12 + 4


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows with a start."""
    return table(spark, sf_dir, "orders").withColumn("start", F.date_format("o_orderdate", "yyyy-MM-dd"))


def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a schedule of three days, of which the last two lie five and eleven weeks after the start."""
    days = F.transform(F.array(F.lit(0), F.lit(35), F.lit(77)), lambda k: F.struct(S.shift(F.col("start"), k).alias("airDate"), F.lit("confirmed").alias("status")))
    return starts(spark, sf_dir).withColumn("schedule", days).withColumns({"primary": S.primary_order(F.col("start")), "active": S.active_orders(F.col("schedule"))})


def instant(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


_D = "CAST(o_orderdate AS DATE)"
_ACTIVE = f"""SELECT *, {order_of("d")} AS primary_order, list_sort(list_distinct([{calendar_order("d")}, {calendar_order("(d + INTERVAL 35 DAY)")}, {calendar_order("(d + INTERVAL 77 DAY)")}])) AS active
FROM (SELECT *, {_D} AS d FROM orders)"""


@query(f"SELECT {year_of(_D)} AS year, {quarter_of(_D)} AS quarter, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2")
def season_primary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = S.primary_season(F.col("start"))
    return starts(spark, sf_dir).groupBy(season["year"].alias("year"), season["quarter"].alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query(f"SELECT {calendar_order(_D)} AS calendar, {order_of(_D)} AS counted, count(*) AS n FROM orders GROUP BY 1, 2")
def season_calendar_vs_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("start")
    return starts(spark, sf_dir).groupBy(S.calendar_order(start).alias("calendar"), S.primary_order(start).alias("counted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_custkey, array_to_string(list_sort(list_distinct(list({calendar_order(_D)}))), ',') AS seasons, count(*) AS n FROM orders GROUP BY 1")
def active_seasons_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = F.array_sort(F.collect_set(S.calendar_order(F.col("start"))))
    return starts(spark, sf_dir).groupBy("o_custkey").agg(F.array_join(seasons.cast("array<string>"), ",").alias("seasons"), F.count(F.lit(1)).alias("n"))


def _page(rows: DataFrame, actual: int) -> DataFrame:
    """A season's page: rows that count for it and, if it is the current one, older ones that still run; by weekday, price, start and key."""
    first, after = S.start_bounds(ASKED)
    # The range that the season implies reaches the scan; the rules on it do not.
    day = F.col("o_orderdate")
    rows = rows.where(day < F.lit(after) if actual == ASKED else (day >= F.lit(first)) & (day < F.lit(after)))
    order = F.col("primary")
    runs = F.array_contains("active", ASKED)
    seen = rows.where((order == ASKED) | (F.lit(ASKED == actual) & (order < ASKED) & runs)).withColumn("weekday", S.update_weekday(F.lit(None).cast("int"), F.col("schedule"), F.col("start")))
    placed = R.numbered(seen, ["weekday", "o_orderstatus", "start"], ["o_orderkey"])
    return placed.select("o_orderkey", "place", F.col("primary").alias("primary_order"))


_PAGE = "SELECT o_orderkey, row_number() OVER (ORDER BY isodow(d), o_orderstatus, d, o_orderkey) AS place, primary_order FROM ({}) WHERE primary_order = {}"


@query(_PAGE.format(_ACTIVE, ASKED))
def season_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(scheduled(spark, sf_dir), ASKED + 3)


@query(_PAGE.format(_ACTIVE, ASKED) + f" OR (primary_order < {ASKED} AND list_contains(active, {ASKED}))")
def season_page_continuing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(scheduled(spark, sf_dir), ASKED)


@query(f"SELECT CASE WHEN NOT list_contains(active, {ASKED}) THEN 'not_active' WHEN primary_order < {ASKED} THEN 'continuing' ELSE 'new' END AS class, count(*) AS n FROM ({_ACTIVE}) GROUP BY 1")
def membership_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = starts(spark, sf_dir).select("start", *(S.shift(F.col("start"), F.lit(k)).alias(f"d{k}") for k in (35, 77)))
    active = F.transform(F.array("start", "d35", "d77"), S.calendar_season)
    return rows.groupBy(S.membership(S.primary_season(F.col("start")), active, F.lit(ASKED)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_END = "last_day(date_trunc('quarter', {0}) + INTERVAL 2 MONTH)"


def _past(day: str) -> str:
    return f"epoch(TIMESTAMP '{NOW}') - epoch(CAST({_END.format(day)} AS TIMESTAMP) + INTERVAL '14:59:59') > 90 * 86400"


@query(f"""SELECT status, ended, count(*) AS n FROM (SELECT CASE WHEN CAST(d AS TIMESTAMP) - INTERVAL 9 HOUR > TIMESTAMP '{NOW}' THEN 'announced' WHEN {_past("d")} THEN 'finished' ELSE 'airing' END AS status,
  CASE WHEN CAST(d AS TIMESTAMP) - INTERVAL 9 HOUR <= TIMESTAMP '{NOW}' AND {_past("d")} THEN strftime({_END.format("d")}, '%Y-%m-%d') END AS ended FROM (SELECT {_D} AS d FROM orders)) GROUP BY 1, 2""")
def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = S.lifecycle(F.col("start"), instant(NOW))
    return starts(spark, sf_dir).groupBy(life["status"].alias("status"), life["endDate"].alias("ended")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN CAST(d AS TIMESTAMP) - INTERVAL 9 HOUR > TIMESTAMP '{NOW}' THEN 'announced'
  WHEN CAST(d + INTERVAL 84 DAY AS TIMESTAMP) + INTERVAL '14:59:59' < TIMESTAMP '{NOW}' THEN 'finished' ELSE 'airing' END AS status FROM (SELECT {_D} AS d FROM orders)) GROUP BY 1""")
def status_from_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("start")
    return starts(spark, sf_dir).groupBy(S.status_of(start, S.shift(start, F.lit(84)), instant(NOW)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_LINES = "(SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_quantity > 25) AS known, max(CAST(l_shipdate AS DATE)) FILTER (l_quantity > 25) AS last FROM lineitem GROUP BY 1)"


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines are episodes; those of large quantity are scheduled, and an odd key doesn't know their number."""
    large = F.col("l_quantity") > 25
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("lines"), F.count_if(large).cast("int").alias("known"), F.max(F.when(large, F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("last"))
    rows = starts(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.withColumn("episodes", F.when(F.col("o_orderkey") % 2 == 0, F.col("lines")))


@query(f"""SELECT o_orderkey, strftime(CASE WHEN known > 0 THEN CASE WHEN known < episodes THEN d + CAST((episodes - 1) * 7 AS INTEGER) ELSE last END
  WHEN episodes IS NOT NULL THEN d + CAST((episodes - 1) * 7 AS INTEGER) WHEN {_past("d")} THEN {_END.format("d")} END, '%Y-%m-%d') AS ended
FROM (SELECT *, {_D} AS d, CASE WHEN o_orderkey % 2 = 0 THEN lines END AS episodes FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey)""")
def end_date_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _episodes(spark, sf_dir).select("o_orderkey", S.end_of(F.col("last"), F.col("known"), F.col("start"), F.col("episodes"), instant(NOW)).alias("ended"))


@query(f"SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 3 WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(isodow({_D}) AS INTEGER) END AS weekday, count(*) AS n FROM orders GROUP BY 1")
def update_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", F.lit("delayed")).otherwise(F.lit("confirmed"))
    schedule = F.array(*(F.struct(S.shift(F.col("start"), F.lit(k)).alias("airDate"), status.alias("status")) for k in (7, 0, 14)))
    given = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(3))
    return starts(spark, sf_dir).groupBy(S.update_weekday(given, schedule, F.col("start")).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT week_minute, CAST(week_minute // 1440 + 1 AS INTEGER) AS weekday, printf('%02d:%02d', (week_minute % 1440) // 60, week_minute % 60) AS time, count(*) AS n
FROM (SELECT CAST(((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) - CASE WHEN event_id % 3 = 0 THEN 0 ELSE 60 END + 10080) % 10080 AS INTEGER) AS week_minute FROM events) GROUP BY ALL""")
def slot_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("event_id") % 3 == 0, F.lit(S.CHINA)).otherwise(F.lit(S.JAPAN))
    day, time = S.weekday(F.date_format("ts", "yyyy-MM-dd")), F.date_format("ts", "HH:mm")
    slot = S.china_slot(day, time, zone)
    return table(spark, sf_dir, "events").groupBy(S.week_minute(day, time, zone).cast("int").alias("week_minute"), slot["weekday"].alias("weekday"), slot["time"].alias("time")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, time, row_number() OVER (ORDER BY time NULLS LAST, event_id) AS place FROM (
  SELECT event_id, event_type, CAST(w // 1440 + 1 AS INTEGER) AS weekday, printf('%02d:%02d', (w % 1440) // 60, w % 60) AS time
  FROM (SELECT *, CAST(((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) - 60 + 10080) % 10080 AS INTEGER) AS w FROM events)) WHERE weekday = 3 AND event_type IN ('click', 'view')""")
def follow_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = S.china_slot(S.weekday(F.date_format("ts", "yyyy-MM-dd")), F.date_format("ts", "HH:mm"), F.lit(S.JAPAN))
    rows = table(spark, sf_dir, "events").withColumn("slot", slot).where((F.col("slot.weekday") == 3) & F.col("event_type").isin("click", "view"))
    return R.numbered(rows.select("event_id", F.col("slot.time").alias("time")), ["time"], ["event_id"])


@query("""SELECT user_id, count(*) FILTER (m < 750) AS marker, count(*) FILTER (abs(m - 750) <= 10) AS current, count(*) AS n FROM (SELECT user_id, hour(ts) * 60 + minute(ts) AS m FROM events) GROUP BY 1""")
def now_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where half past twelve falls among a user's slots, and how many are within ten minutes of it."""
    minute = S.minutes(F.date_format("ts", "HH:mm"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(minute < 750).alias("marker"), F.count_if(F.abs(minute - 750) <= 10).alias("current"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderkey, CAST(k + 1 AS INTEGER) AS episode, strftime(d + CAST(7 * k AS INTEGER), '%Y-%m-%d') AS day FROM (SELECT o_orderkey, d, unnest(range(lines)) AS k FROM
  (SELECT o_orderkey, {_D} AS d, lines FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey))""")
def weekly_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.weekly_days(F.col("start"), F.col("lines"))
    return _episodes(spark, sf_dir).select("o_orderkey", F.posexplode(days).alias("k", "day")).select("o_orderkey", (F.col("k") + 1).alias("episode"), "day")


@query(f"""SELECT o_orderkey, CAST(CASE WHEN episodes IS NULL THEN a ELSE least(a, episodes) END AS INTEGER) AS aired FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lines - 2 END AS episodes,
  len(list_filter(range(lines), lambda k: {_D} + CAST(7 * k AS INTEGER) <= DATE '1998-06-01')) AS a FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey)""")
def aired_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.weekly_days(F.col("start"), F.col("lines"))
    return _episodes(spark, sf_dir).select("o_orderkey", S.aired(days, F.lit("1998-06-01"), F.col("episodes") - 2).cast("int").alias("aired"))


@query(f"""SELECT label, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN '已完结' WHEN o_orderkey % 5 = 0 THEN '暂未确定'
  WHEN o_orderkey % 5 = 1 THEN ['周一', '周二', '周三', '周四', '周五', '周六', '周日'][isodow({_D})] || ' 时间待定' ELSE ['周一', '周二', '周三', '周四', '周五', '周六', '周日'][isodow({_D} - 1)] || ' 23:30' END AS label FROM orders) GROUP BY 1""")
def slot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that a page shows; half past midnight in Japan is the evening before in China."""
    status = F.when(F.col("o_orderstatus") == "F", F.lit("finished")).otherwise(F.lit("airing"))
    day = F.when(F.col("o_orderkey") % 5 != 0, S.weekday(F.col("start")))
    time = F.when(F.col("o_orderkey") % 5 != 1, F.lit("00:30"))
    return starts(spark, sf_dir).groupBy(S.slot_label(status, day, time, F.lit(S.JAPAN)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, strftime(ts - INTERVAL 9 HOUR + INTERVAL 8 HOUR, '%Y-%m-%d') AS date, strftime(ts - INTERVAL 9 HOUR + INTERVAL 8 HOUR, '%H:%M') AS time FROM events")
def instant_to_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as instants with Japan's offset, seen from China."""
    slot = S.instant_slot(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
    return table(spark, sf_dir, "events").select("event_id", slot["date"].alias("date"), slot["time"].alias("time"))


@query(f"""SELECT year, first, count(*) AS n FROM (SELECT CAST(y AS INTEGER) AS year, CAST(f AS INTEGER) AS first, unnest([y * 12 + f - 2, y * 12 + f - 1, y * 12 + f, y * 12 + f + 1]) AS m FROM (VALUES (1997, 1), (1998, 10)) AS s(y, f))
  JOIN orders ON year({_D}) * 12 + month({_D}) - 1 = m GROUP BY ALL""")
def lookup_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the months that a season's candidates come from."""
    asked = [(y, f, 12 * a + b) for y, f in ((1997, 1), (1998, 10)) for a, b in S.lookup_months(y, f)]
    months = spark.createDataFrame(asked, "year int, first int, month int")
    rows = table(spark, sf_dir, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month"))
    return rows.join(F.broadcast(months), "month").groupBy("year", "first").agg(F.count(F.lit(1)).alias("n"))  # months: four for each season asked for
