"""What pages show: labels of seasons, states, counts and ratings, and a request's parameters."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seasons import QUARTER_LABELS, yes

#: Labels of states and of data states.
STATUS_LABELS = {"announced": "未开播", "airing": "连载中", "finished": "已完结", "delayed": "延期", "cancelled": "已取消", "unknown": "未知"}
DATA_LABELS = {"complete": "完整", "partial": "信息缺失", "conflicting": "来源冲突", "unverified": "待确认"}


def _looked_up(value: Column, labels: dict[str, str], other: str | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), F.lit(other).cast("string"))


def status_label(status: Column) -> Column:
    return _looked_up(status, STATUS_LABELS)


def data_label(status: Column) -> Column:
    return _looked_up(status, DATA_LABELS)


def season_label(season: Column) -> Column:
    named = F.concat(season["year"].cast("string"), F.lit("年 "), _looked_up(season["quarter"], QUARTER_LABELS, "未知季度"))
    return F.when(season.isNull(), F.lit("季度待确认")).otherwise(named)


def episodes_label(count: Column) -> Column:
    return F.coalesce(F.concat(F.lit("全 "), count.cast("string"), F.lit(" 集")), F.lit("待确认"))


def date_label(date: Column) -> Column:
    return F.coalesce(date, F.lit("待确认"))


def rating_label(rating: Column) -> Column:
    """struct(score, note): one decimal and the number of ratings, or why there is none."""
    people = F.coalesce(F.concat(rating["ratingCount"].cast("string"), F.lit(" 人")), F.lit("评分人数待确认"))
    none = F.when(rating["subjectId"].isNull(), F.lit("未匹配 Bangumi")).otherwise(F.lit("暂无公开评分"))
    known = yes(rating["rating"].isNotNull())
    return F.struct(F.when(known, F.format_number(rating["rating"], 1)).otherwise(F.lit("暂无评分")).alias("score"), F.when(known, people).otherwise(none).alias("note"))


def season_parameter(text: str | None) -> int | None:
    """The first month of a quarter from a request's parameter; None for anything else."""
    return int(text) if text in ("1", "4", "7", "10") else None


def season_query(year: int, month: int, include_optional: bool = True, include_needs_review: bool = True) -> str:
    """A season page's query string."""
    flag = lambda b: str(b).lower()
    return urlencode({"year": year, "season": month, "includeOptional": flag(include_optional), "includeNeedsReview": flag(include_needs_review)})
