from pyspark.sql import functions as F

from loomline.functions import labels as L


def test_labels(spark):
    season = F.struct(F.lit(2026).alias("year"), F.lit("summer").alias("quarter"))
    rating = lambda r, n, s: F.struct(F.lit(r).cast("double").alias("rating"), F.lit(n).cast("int").alias("ratingCount"), F.lit(s).cast("long").alias("subjectId"))
    r = spark.range(1).select(
        L.status_label(F.lit("airing")).alias("a"), L.data_label(F.lit("odd")).alias("b"), L.season_label(season).alias("c"), L.season_label(F.when(F.lit(False), season)).alias("d"), L.episodes_label(F.lit(12)).alias("e"),
        L.episodes_label(F.lit(None).cast("int")).alias("f"), L.date_label(F.lit(None).cast("string")).alias("g"), L.rating_label(rating(7.25, 10, 1)).alias("h"), L.rating_label(rating(None, None, None)).alias("i"), L.rating_label(rating(None, None, 3)).alias("j"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("连载中", None, "2026年 七月新番", "季度待确认", "全 12 集", "待确认", "待确认")
    assert r.h.note == "10 人" and tuple(r.i) == ("暂无评分", "未匹配 Bangumi") and r.j.note == "暂无公开评分"


def test_parameters():
    assert [L.season_parameter(t) for t in ("1", "10", "2", "", None)] == [1, 10, None, None, None]
    assert L.season_query(2026, 7, False) == "year=2026&season=7&includeOptional=false&includeNeedsReview=true"
