"""Dates, seasons, slots and lifecycles on fixed vectors."""

from datetime import timedelta

from pyspark.sql import functions as F

from loomline.functions import seasons as S
from loomline.functions import text as X



def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_primary_season_leads_into_the_next_quarter(spark):
    days = {"2026-03-17": (2026, "winter"), "2026-03-18": (2026, "spring"), "2026-06-16": (2026, "spring"), "2026-06-17": (2026, "summer"), "2026-09-16": (2026, "summer"), "2026-09-17": (2026, "fall"), "2026-12-17": (2026, "fall"), "2026-12-18": (2027, "winter"), "2026-01-31": (2026, "winter")}
    got = {r.d: r.s for r in spark.createDataFrame([(d,) for d in [*days, None, "2026-02-29", "2026-2-9", "x"]], "d string").select("d", S.primary_season(F.col("d")).alias("s")).collect()}
    for day, season in days.items():
        assert (got[day].year, got[day].quarter) == season
    assert got[None] is None and got["2026-02-29"] is None and got["2026-2-9"] is None and got["x"] is None


def test_current_season_is_chinas(spark):
    at = lambda t: S.current_season(F.to_timestamp(F.lit(t)))["quarter"]
    r = one(spark, a=at("2026-03-17T15:59:59Z"), b=at("2026-03-17T16:00:00Z"))
    assert (r.a, r.b) == ("winter", "spring")


def test_active_seasons(spark):
    days = F.array(*(F.struct(F.lit(d).alias("airDate")) for d in ("2026-01-02", "2025-10-10", "2025-12-26", "2026-01-09")))
    r = one(spark, a=S.active_seasons(days, S.primary_season(F.lit("2026-01-02"))), b=S.active_seasons(F.array().cast("array<struct<airDate:string>>"), S.primary_season(F.lit("2026-03-20"))), c=S.active_seasons(F.array().cast("array<struct<airDate:string>>"), S.primary_season(F.lit(None).cast("string"))))
    assert [tuple(s) for s in r.a] == [(2025, "fall"), (2026, "winter")] and [tuple(s) for s in r.b] == [(2026, "spring")] and r.c == []


def test_update_weekday(spark):
    none = F.lit(None).cast("int")
    entry = lambda d, s="confirmed": F.array(F.struct(F.lit(d).alias("airDate"), F.lit(s).alias("status")))
    empty = F.array().cast("array<struct<airDate:string,status:string>>")
    r = one(spark, a=S.update_weekday(none, entry("2026-07-03"), F.lit("2026-07-01")), b=S.update_weekday(none, empty, F.lit("2026-07-04")), c=S.update_weekday(none, entry("2026-07-03", "delayed"), F.lit("2026-07-01")), d=S.update_weekday(F.lit(2), empty, F.lit("x")), e=S.update_weekday(F.lit(9), empty, F.lit("x")))
    assert (r.a, r.b, r.c, r.d, r.e) == (5, 6, None, 2, None)


def test_slots(spark):
    r = one(
        spark, a=S.china_slot(F.lit(5), F.lit("00:30"), F.lit("Asia/Tokyo")), b=S.china_slot(F.lit(1), F.lit("00:30"), F.lit("Asia/Tokyo")), c=S.china_slot(F.lit(5), F.lit("23:30"), F.lit("Asia/Shanghai")), d=S.china_slot(F.lit(5), F.lit("24:30"), F.lit("Asia/Tokyo")),
        e=S.slot_label(F.lit("airing"), F.lit(5), F.lit("00:30"), F.lit("Asia/Tokyo")), f=S.instant_slot(F.lit("2026-07-17T23:30:00+09:00")), g=S.instant_slot(F.lit("2026-07-17")), h=S.instant_slot(F.lit("soon")),
    )
    assert tuple(r.a) == (4, "23:30") and tuple(r.b) == (7, "23:30") and tuple(r.c) == (5, "23:30") and r.d is None and r.e == "周四 23:30"
    assert tuple(r.f) == ("2026-07-17", "22:30") and tuple(r.g) == ("2026-07-16", "23:00") and r.h is None


def test_lifecycles(spark):
    now = F.to_timestamp(F.lit("2026-07-28T03:00:00Z"))
    r = one(
        spark, a=S.lifecycle(F.lit("2024-04-05"), now), b=S.lifecycle(F.lit("2026-08-01"), now), c=S.lifecycle(F.lit("2026-07-05"), now), d=S.end_of(F.lit(None).cast("string"), F.lit(0), F.lit("2025-07-19"), F.lit(11), now),
        e=S.end_of(F.lit(None).cast("string"), F.lit(0), F.lit("2025-07-15"), F.lit(None).cast("int"), now), f=S.status_of(F.lit("2025-07-19"), F.lit("2025-09-27"), now), g=S.status_of(F.lit(None).cast("string"), F.lit(None).cast("string"), now),
        h=S.precision(F.lit("2026-07")), i=S.weekly_days(F.lit("2026-07-03"), F.lit(3)), j=S.aired(S.weekly_days(F.lit("2026-07-03"), F.lit(3)), F.lit("2026-07-10"), F.lit(1)),
    )
    assert tuple(r.a) == ("finished", "2024-06-30") and tuple(r.b) == ("announced", None) and tuple(r.c) == ("airing", None)
    assert (r.d, r.e, r.f, r.g, r.h) == ("2025-09-27", "2025-09-30", "finished", "unknown", "month") and r.i == ["2026-07-03", "2026-07-10", "2026-07-17"] and r.j == 1


def test_membership(spark):
    season = lambda y, q: F.struct(F.lit(y).alias("year"), F.lit(q).alias("quarter"))
    active = F.array(season(2026, "winter"), season(2026, "spring"))
    r = one(spark, **{q: S.membership(season(2026, "winter"), active, S.season_order(season(2026, q))) for q in ("winter", "spring", "summer")})
    assert (r.winter, r.spring, r.summer) == ("new", "continuing", "not_active")
    assert S.lookup_months(2026, 1) == [(2025, 12), (2026, 1), (2026, 2), (2026, 3)]


def test_text(spark):
    texts = ["銀河".encode().decode("latin-1"), "été", "ＡＢＣ　d", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.repair(F.col("t")).alias("r"), X.content_text(F.col("t")).alias("c"), X.merge_title(F.col("t")).alias("m")).orderBy("i").collect()
    assert [x.r for x in rows] == ["銀河", "été", "ＡＢＣ　d", None] and rows[2].c == "abc d" and rows[2].m == "abcd" and rows[3].m is None
    r = one(spark, a=X.numeral(F.lit("二十三")), b=X.numeral(F.lit("十")), c=X.numeral(F.lit("x")), d=X.numeral(F.lit("12")), e=X.trim(F.lit("　a \t")), g=X.genres(F.array(F.lit("a love story"), F.lit("魔法少女"), F.lit("glove"))))
    assert (r.a, r.b, r.c, r.d, r.e) == (23, 10, None, 12, "a") and r.g == ["恋爱", "奇幻"]


def test_start_bounds_are_those_of_primary_seasons(spark):
    for order in (2026 * 12 + 1, 2026 * 12 + 4, 2026 * 12 + 7, 2026 * 12 + 10):
        first, after = S.start_bounds(order)
        days = [first - timedelta(days=1), first, after - timedelta(days=1), after]
        got = [r.o for r in spark.createDataFrame([(str(d),) for d in days], "d string").select(S.primary_order(F.col("d")).alias("o")).collect()]
        assert got == [order - 3, order, order, order + 3]
