"""Monthly subject snapshots of the subject database, and their items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT
from pyspark.sql.utils import AnalysisException

from .. import schema as T
from ..functions import fixed
from ..functions import seasons as S
from ..functions import text as X
from ..operators import match, rules
from ..operators import records as R
from .library import empty_rating, item_from

#: A subject as it is read: its bag's values stay JSON, as their type differs.
_RAW = PT.StructType([f if f.name != "infobox" else PT.StructField("infobox", PT.StringType()) for f in T.SUBJECT.fields])
_MONTH = re.compile(r"(\d{4})(\d{2})-subjects\.json")


def read(spark: SparkSession, folder: str, months: list[tuple[int, int]] | None = None) -> DataFrame:
    """Subjects of the snapshots in a folder: month, ordinal and a subject's columns.

    A file is an array of subjects or an object with them under ``data``; only
    series (type 2) with an id and a name count.  Of files, only those of the
    months asked for are opened; a month without a file has no subjects.
    """
    pattern = "*-subjects.json" if months is None else "*{" + ",".join(f"{y}{m:02d}" for y, m in months) + "}-subjects.json"
    try:
        files = spark.read.text(f"{folder}/{pattern}", wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], PT.StructType([PT.StructField("month", PT.IntegerType()), PT.StructField("ordinal", PT.IntegerType()), *T.SUBJECT.fields]))
    name = F.input_file_name()
    month = F.regexp_extract(name, _MONTH.pattern, 1).cast("int") * 12 + F.regexp_extract(name, _MONTH.pattern, 2).cast("int") - 1
    text = F.regexp_replace("value", "^﻿", "")
    rows = F.coalesce(F.get_json_object(text, "$.data"), text)
    parsed = F.from_json(rows, PT.ArrayType(_RAW))
    subjects = files.select(month.alias("month"), F.posexplode(parsed).alias("ordinal", "s")).select("month", "ordinal", "s.*")
    good = subjects.where((F.col("type") == 2) & F.col("id").isNotNull() & S.yes(F.length("name") > 0))
    return good.withColumn("infobox", bag(F.col("infobox"))).select("month", "ordinal", *T.SUBJECT.fieldNames())


def bag(text: Column) -> Column:
    """A bag of facts from JSON: a value per row, from texts, lists, and objects with v or value."""
    raw = F.from_json(text, "array<struct<key:string,value:string>>")

    def values(v: Column) -> Column:
        listed = F.from_json(v, "array<string>")
        single = lambda x: F.coalesce(F.get_json_object(x, "$.v"), F.get_json_object(x, "$.value"), x)
        return F.when(v.startswith("["), F.transform(listed, single)).when(v.startswith("{"), F.array(F.coalesce(F.get_json_object(v, "$.v"), F.get_json_object(v, "$.value")))).otherwise(F.array(v))

    flat = F.flatten(F.transform(raw, lambda e: F.transform(values(e["value"]), lambda v: F.struct(e["key"].alias("key"), v.alias("value")))))
    return F.filter(F.coalesce(flat, F.array().cast(T.BAG)), lambda e: e["value"].isNotNull())


def latest(subjects: DataFrame) -> DataFrame:
    """One row for each id: the last one's values (by month and place)."""
    return R.first_by_key(subjects.withColumn("_o", -(F.col("month").cast("long") * 1_000_000 + F.col("ordinal"))), ["id"], ["_o"]).drop("_o")


def values(box: Column, keys: tuple[str, ...]) -> Column:
    """Repaired, trimmed, distinct values under the keys, in order."""
    wanted = [X.content_key(k) for k in keys]
    names = X.content_texts(F.transform(box, lambda e: F.coalesce(e["key"], F.lit(" "))))
    texts = X.repair_all(F.transform(box, lambda e: e["value"]))
    chosen = F.filter(F.arrays_zip(names.alias("k"), texts.alias("v")), lambda e: e["k"].isin(*wanted))
    return F.filter(F.array_distinct(F.transform(chosen, lambda e: X.trim(e["v"]))), lambda v: F.length(v) > 0)


def with_facts(subjects: DataFrame) -> DataFrame:
    """Subjects with repaired names and the facts that mapping and matching use: aliases, sites, studios, works, countries, makers, tag_names."""
    box = F.filter(F.coalesce("infobox", F.array().cast(T.BAG)), lambda e: S.yes(F.length(X.trim(e["key"])) > 0) & (F.length(e["value"]) > 0))
    rows = subjects.withColumn("infobox", box).withColumns({"name": X.repair(F.col("name")), "name_cn": X.filled(X.repair(F.col("name_cn")))})
    box = F.col("infobox")
    tags = F.filter(F.transform(X.repair_all(F.coalesce("tags.name", F.array().cast("array<string>"))), lambda t: X.trim(t)), lambda t: F.length(t) > 0)
    forms = F.array_distinct(F.concat(values(box, fixed.ALIAS_KEYS), values(box, fixed.ENGLISH_KEYS)))
    aliases = F.filter(forms, lambda a: (a != F.col("name")) & (a != F.coalesce("name_cn", F.lit(""))))
    return rows.withColumns({
        "aliases": aliases, "sites": values(box, fixed.SITE_KEYS), "studios": values(box, fixed.STUDIO_KEYS), "works": values(box, fixed.WORK_KEYS),
        "countries": values(box, fixed.COUNTRY_KEYS), "makers": values(box, fixed.MAKER_KEYS), "tag_names": tags,
    })


def origin() -> Column:
    """Why a subject isn't Japanese; null if it is."""
    c = F.col
    site = F.get("sites", F.lit(0))
    texts = lambda *parts: X.content_texts(F.filter(F.concat(*parts), lambda t: t.isNotNull()))
    titles = F.array("name", "name_cn", site)
    keys = texts(titles, "aliases")
    made = texts(F.array(site), "tag_names", "studios")
    japanese = rules.kana(c("name")) & X.any_matches(made, (fixed.JAPANESE_DOMAIN, "日本|japan|japanese", fixed.JAPANESE_STUDIOS))
    around = F.lower(X.nfkc(F.array_join(F.filter(F.concat(F.array("name", "name_cn", "platform", site), "makers"), lambda t: t.isNotNull()), " ")))
    foreign = rules.foreign_title(keys) | rules.korean(c("name")) | rules.foreign_tags(texts("tag_names", "countries", titles, "aliases"))
    other = F.lit("Not Japanese anime")
    return (
        F.when(S.yes(c("nsfw")), F.lit("R18 or NSFW content")).when(S.yes(c("id").isin(*fixed.FOREIGN_SUBJECTS)), other).when(rules.foreign_brand(keys), other).when(japanese, F.lit(None)).when(foreign, other)
        .when(rules.foreign_title(texts(F.array(around))), other).when(X.matches(around, "日本|japan|japanese"), F.lit(None)).when(X.matches(around, fixed.ADULT), F.lit("R18 or adult content"))
    ).cast("string")


def exclusion() -> Column:
    """Why a subject's content stays out; null if it doesn't."""
    keys = X.content_texts(F.filter(F.concat(F.array("name", "name_cn", "platform", F.get("sites", F.lit(0))), "aliases"), lambda t: t.isNotNull()))
    return F.when(rules.listed_subject(F.col("id")), F.lit("Known out-of-scope subject")).when(rules.movie(keys), F.lit("Theatrical movie")).when(rules.special(keys), F.lit("Non-TV special")).when(rules.late_season(keys), F.lit("Season number exceeds 10"))


def positive(value: Column) -> Column:
    """A whole positive number, or null."""
    return F.when(S.yes(value > 0) & (value == F.floor(value)), value.cast("int"))


def episodes_to_schedule(episodes: Column, source: Column) -> Column:
    """Regular episodes with a day, as a schedule."""
    regular = F.filter(episodes, lambda e: (F.coalesce(e["type"], F.lit(0)) == 0) & S.is_date(e["airdate"]))
    blank = F.lit(None).cast("string")
    return F.transform(regular, lambda e: F.struct(
        F.coalesce(positive(e["ep"]), positive(e["sort"])).alias("episodeNumber"), F.coalesce(X.filled(e["name_cn"]), X.filled(e["name"])).alias("episodeTitle"), e["airdate"].alias("airDate"), blank.alias("airTime"),
        F.lit(S.JAPAN).alias("timezone"), F.lit("confirmed").alias("status"), source.alias("source"), blank.alias("rawTimeText")).cast(T.EPISODE))


def source_struct(subject: Column, at: Column) -> Column:
    return F.struct(F.lit("Bangumi").alias("name"), F.lit("bangumi").alias("type"), F.concat(F.lit("https://bgm.tv/subject/"), subject.cast("string")).alias("url"), at.alias("retrievedAt"), F.lit(None).cast("double").alias("confidence"), F.lit("metadata").alias("scope"))


def cover(images: Column) -> Column:
    sizes = F.struct(F.coalesce(images["large"], images["common"]).alias("large"), F.coalesce(images["medium"], images["common"]).alias("medium"), F.coalesce(images["small"], images["grid"]).alias("small"), F.lit("bangumi").alias("source"))
    return F.when(images.isNotNull(), sizes)


def placeholder(spark: SparkSession, year: int, month: int, at: str) -> DataFrame:
    """The one item that stands for a season whose snapshot can't be had: nothing is known of it, and it needs a review."""
    quarter = S.month_quarter(F.lit(month))
    season = F.struct(F.lit(year).alias("year"), quarter.alias("quarter"))
    named = lambda form: F.format_string(form, F.lit(year), quarter)
    blank = F.lit(None).cast("string")
    return item_from(
        spark.range(1), id=named("anime:mock-bangumi-%d-%s"), title=F.struct(named("Mock Bangumi %d %s").alias("original"), blank.alias("japanese"), blank.alias("chinese"), blank.alias("english"), F.array().cast("array<string>").alias("aliases")),
        format=F.lit("unknown"), status=F.lit("unknown"), startDate=F.lit(f"{year}-{month:02d}-01"), datePrecision=F.lit("day"), primarySeason=season, activeSeasons=F.array(season), timezone=F.lit(S.JAPAN),
        isJapaneseAnime=F.lit(True), inclusionStatus=F.lit("needs_review"), externalIds=F.struct(F.lit(None).cast("long").alias("bangumiSubjectId"), blank.alias("bahamutSn")), bangumi=empty_rating(F.lit(None)),
        schedule=F.array().cast(PT.ArrayType(T.EPISODE)), sources=F.array().cast(PT.ArrayType(T.SOURCE)), dataStatus=F.lit("unverified"), updatedAt=F.lit(at), createdAt=F.lit(at),
    )


def to_items(subjects: DataFrame, at: str, episodes: DataFrame | None = None) -> DataFrame:
    """Items of subjects; ``episodes`` has the columns of an episode, with subject_id."""
    rows = with_facts(subjects).withColumn("_source", source_struct(F.col("id"), F.lit(at)))
    if episodes is None:
        rows = rows.withColumn("_eps", F.array().cast(PT.ArrayType(T.SUBJECT_EPISODE)))
    else:
        listed = episodes.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("sort", F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.SUBJECT_EPISODE.fields)).alias("e")))).alias("_l"))
        rows = rows.join(listed, F.col("id") == F.col("subject_id"), "left").withColumn("_eps", F.coalesce(F.transform("_l", lambda x: x["e"]), F.array().cast(PT.ArrayType(T.SUBJECT_EPISODE))))
    rows = rows.withColumn("_schedule", episodes_to_schedule(F.col("_eps"), F.col("_source")))
    c, now = F.col, F.try_to_timestamp(F.lit(at))
    start = F.when(S.is_date(c("date")), c("date"))
    known = F.size("_schedule")
    told = F.coalesce(positive(c("eps")), positive(c("total_episodes")))
    aired = F.when(known > 0, known).otherwise(positive(c("total_episodes")))
    clash = S.yes(aired > told)
    count = F.when(~clash, told)
    rows = rows.withColumns({"_start": start, "_count": count, "_origin": origin(), "_out": exclusion(), "_format": match.platform_format(c("platform"))})
    rows = rows.withColumn("_end", S.end_of(F.get("_schedule", known - 1)["airDate"], known, c("_start"), c("_count"), now))
    primary = S.primary_season(c("_start"))
    usual = F.when(c("_format").isin("tv", "web"), F.lit("included")).when(c("_format").isin("ova", "movie", "sp"), F.lit("optional")).otherwise(F.lit("needs_review"))
    rating = c("rating")
    facts = F.struct(c("id").alias("subjectId"), c("_source.url").alias("url"), F.when(rating["score"] > 0, rating["score"]).alias("rating"), positive(rating["total"]).alias("ratingCount"), F.coalesce(positive(c("rank")), positive(rating["rank"])).alias("rank"), F.lit(at).alias("lastSyncedAt"))
    return item_from(
        rows, id=F.concat(F.lit("anime:"), c("id").cast("string")), title=F.struct(c("name").alias("original"), c("name").alias("japanese"), c("name_cn").alias("chinese"), F.lit(None).cast("string").alias("english"), c("aliases")),
        format=c("_format"), status=S.status_of(c("_start"), c("_end"), now), startDate=c("_start"), endDate=c("_end"), datePrecision=S.precision(c("date")), primarySeason=primary,
        activeSeasons=S.active_seasons(c("_schedule"), primary), updateWeekday=S.update_weekday(F.lit(None).cast("int"), c("_schedule"), c("_start")), timezone=F.lit(S.JAPAN), episodeCount=c("_count"), airedEpisodeCount=aired,
        isJapaneseAnime=c("_origin").isNull(), inclusionStatus=F.when(c("_origin").isNull() & c("_out").isNull(), usual).otherwise(F.lit("excluded")), exclusionReason=F.coalesce("_origin", "_out"),
        officialUrl=F.get("sites", F.lit(0)), coverImage=cover(c("images")), externalIds=F.struct(c("id").alias("bangumiSubjectId"), F.lit(None).cast("string").alias("bahamutSn")), bangumi=facts, schedule=c("_schedule"),
        staff=F.struct(c("studios").alias("studio"), F.array().cast("array<string>").alias("productionCommittee"), F.get("works", F.lit(0)).alias("originalWorkType")), sources=F.array("_source"),
        dataStatus=F.when(c("_start").isNull() | (known == 0) | clash, F.lit("partial")).otherwise(F.lit("complete")), updatedAt=F.lit(at), createdAt=F.lit(at),
    )
