"""The matcher on parts: each part is an item and a subject, eight of either in a season, with titles, dates and facts that differ by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as T
from ..functions import fixed
from ..operators import match, merge
from ..sources import library, snapshots
from .registry import query, table

#: Parts of a season; a season's items meet all of its subjects, whatever the number of parts.
TOGETHER = 8
#: Years of an era: the library's dates have years of four digits, so parts go on in the next era, whose calendar is the same.
ERA = 8000
#: What a subject's title is, by key modulo 6, beside the item's own (0): shouted, dashed, prolonged, another, a second season's.
SHOUTED, DASHED, LONGER, OTHER, SECOND = range(1, 6)
#: Items of these keys modulo 9 are second seasons.
SEQUEL = 4
_SECOND_SEASON = " 第2期"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the season's year in its era and quarter (from 0), its fifth day, and a title that no other part has."""
    season, key = F.floor(F.col("p_partkey") / TOGETHER), F.col("p_partkey").cast("string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the file is small, what is made of a part is not
    rows = table(spark, sf_dir, "part").repartition(tasks, "p_partkey").withColumns({"year": (F.floor(season / 4) % ERA + 1900).cast("int"), "quarter": (season % 4).cast("int")})
    titled = lambda k: F.concat(F.substring(F.md5(k), 1, 16), F.lit(" "), "p_name")
    return rows.withColumns({"day": F.make_date("year", F.col("quarter") * 3 + 1, F.lit(5)), "title": titled(key), "another": titled(F.concat(key, F.lit("?")))})


def _era(key: Column) -> Column:
    return F.floor(key / (TOGETHER * 4 * ERA)).alias("era")


def _items(parts: DataFrame) -> DataFrame:
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    original = F.when(key % 9 == SEQUEL, F.concat("title", F.lit(_SECOND_SEASON))).otherwise(F.col("title"))
    official = key % 2 == 0
    source = F.struct(F.when(official, F.lit("Official")).otherwise(F.lit(merge.REVIEWERS[0])).alias("name"), F.when(official, F.lit("official")).otherwise(F.lit("third_party")).alias("type"), none.alias("url"), none.alias("retrievedAt"), F.lit(None).alias("confidence"), none.alias("scope"))
    items = library.item_from(
        parts, id=F.concat(F.lit("anime:"), key.cast("string")), title=F.struct(original.alias("original"), none.alias("japanese"), none.alias("chinese"), none.alias("english"), F.array().cast("array<string>").alias("aliases")),
        format=F.lit("tv"), startDate=F.date_add("day", (key % TOGETHER).cast("int")).cast("string"), primarySeason=F.struct(F.col("year"), F.element_at(F.array(*map(F.lit, T.QUARTERS)), F.col("quarter") + 1).alias("quarter")),
        episodeCount=F.lit(12), officialUrl=F.when(key % 3 == 0, F.concat(F.lit("https://example.org/"), key.cast("string"))), sources=F.array(source),
        staff=F.struct(F.array("p_brand").alias("studio"), F.array().cast("array<string>").alias("productionCommittee"), none.alias("originalWorkType")),
    )
    return items.select(F.struct("*").alias("i"), _era(F.substring_index("id", ":", -1).cast("long")))


def _subjects(parts: DataFrame) -> DataFrame:
    key, title = F.col("p_partkey"), F.col("title")
    pick = lambda by, values, other=None: _pick(key % by, values, F.lit(other))
    names = {SHOUTED: F.upper("title"), DASHED: F.replace("title", F.lit(" "), F.lit("-")), LONGER: F.concat("title", F.lit("s")), OTHER: F.col("another"), SECOND: F.concat("title", F.lit(_SECOND_SEASON))}
    fact = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    site = F.concat(F.lit("https://EXAMPLE.org/"), key.cast("string"), F.lit("/"))
    box = F.concat(F.array(fact(fixed.STUDIO_KEYS[0], F.col("p_brand"))), F.when(key % 2 == 0, F.array(fact(fixed.SITE_KEYS[0], site))).otherwise(F.array().cast(T.BAG)))
    facts = {
        "id": key, "type": pick(11, {0: 1}, 2), "name": _pick(key % 6, names, title), "platform": pick(10, {0: "movie", 1: None}, "TV"), "eps": pick(4, {0: 12, 1: 13, 2: 20}),
        "date": F.when(key % 13 != 0, F.date_add("day", (key % 5).cast("int") * 15).cast("string")), "infobox": box,
    }
    rows = parts.select(*(facts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.SUBJECT.fields))
    return snapshots.with_facts(rows).select(F.struct("*").alias("s"), _era(F.col("id")))


def _pick(by: Column, values: dict, other: Column) -> Column:
    for k, value in values.items():
        other = F.when(by == k, value if isinstance(value, Column) else F.lit(value)).otherwise(other)
    return other


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return match.scored(match.candidate_pairs(_items(parts), _subjects(parts), "era", light=True))


def _sorted(names: str) -> Column:
    return F.array_join(F.sort_array(names), ",")


_SCORED = f"""p AS (SELECT *, p_partkey AS k, make_date(1900 + p_partkey // {TOGETHER} // 4, p_partkey // {TOGETHER} % 4 * 3 + 1, 5) AS day, length(replace(p_name, ' ', '')) + 16 AS n FROM part),
f AS (SELECT i.k AS i, s.k AS s, s.k % 11 = 0 AS no_series, s.k % 10 = 0 AS no_tv, CASE s.k % 4 WHEN 0 THEN 7 WHEN 1 THEN -3 WHEN 2 THEN -8 ELSE 2 END AS eps, i.p_brand = s.p_brand AS studio, i.k = s.k AND s.k % 6 = 0 AS site, i.k % 2 = 0 AS official, s.k % 13 <> 0 AS dated,
  CASE WHEN i.k <> s.k OR s.k % 6 = {OTHER} THEN 0 WHEN s.k % 6 = {LONGER} THEN floor(34 + 8.0::DOUBLE * s.n / (s.n + 1) + 0.5::DOUBLE) WHEN s.k % 6 = {DASHED} OR (s.k % 6 = {SECOND}) <> (i.k % 9 = {SEQUEL}) THEN 42 ELSE 45 END AS title,
  CASE WHEN i.k % 9 <> {SEQUEL} THEN 0 WHEN s.k % 6 = {SECOND} THEN 12 WHEN i.k = s.k AND s.k % 6 < {LONGER} THEN 6 ELSE -12 END AS season,
  CASE WHEN s.k % 13 = 0 THEN 2 WHEN i.k % {TOGETHER} = s.k % 5 * 15 THEN 20 WHEN abs(i.k % {TOGETHER} - s.k % 5 * 15) <= 7 THEN 16 WHEN month(i.day + (i.k % {TOGETHER})::INTEGER) = month(s.day + (s.k % 5 * 15)::INTEGER) THEN 12 ELSE 8 END AS date
  FROM p i JOIN p s ON i.k // {TOGETHER} = s.k // {TOGETHER} WHERE s.k % 13 <> 0 OR (i.k = s.k AND s.k % 6 NOT IN ({LONGER}, {OTHER}))),
scored AS (SELECT *, CAST(greatest(0, least(100, title + season + date + CASE WHEN no_series THEN -45 ELSE 8 END + CASE s % 10 WHEN 0 THEN -15 WHEN 1 THEN 0 ELSE 5 END + eps + 22 * site::INTEGER + 4 * studio::INTEGER + 6 * dated::INTEGER + CASE WHEN official THEN 5 ELSE -6 END)) AS INTEGER) AS score FROM f),
ranked AS (SELECT *, row_number() OVER w AS rank, coalesce(score - lead(score) OVER w, 100) AS ahead FROM scored WINDOW w AS (PARTITION BY i ORDER BY score DESC, s)),
final AS (SELECT *, CASE WHEN ahead < 5 THEN greatest(0, score - 20) WHEN ahead < 12 THEN greatest(0, score - 10) ELSE score END AS points, no_series OR no_tv AS conflict, title > 0 AS name, dated AND date >= 12 AS near, season > 0 OR eps = 7 OR studio AS made FROM ranked)"""


def _risks(close: str) -> str:
    return f"concat_ws(',', CASE WHEN NOT dated THEN 'date_missing' END, CASE WHEN no_series OR no_tv THEN 'format_conflict' END, {close}CASE WHEN season < 0 THEN 'season_token_mismatch' END, CASE WHEN NOT official THEN 'weak_source' END)"


@query(f"""WITH {_SCORED} SELECT 'anime:' || i AS item, s AS candidate, score, concat_ws(',', CASE WHEN dated AND date >= 12 THEN 'date' END, CASE WHEN eps = 7 THEN 'episodeCount' END, CASE WHEN s % 10 > 1 THEN 'format' END, CASE WHEN title > 0 THEN 'name' END,
  CASE WHEN site THEN 'officialUrl' END, CASE WHEN dated AND date = 8 THEN 'quarter' END, CASE WHEN season > 0 THEN 'seasonToken' END, CASE WHEN studio THEN 'studio' END) AS matched, {_risks('')} AS risks FROM scored""")
def subject_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that share a title or a season, with scores, what agrees and what is doubtful."""
    return _scored(spark, sf_dir).select(F.col("i.id").alias("item"), F.col("s.id").alias("candidate"), "score", _sorted("matched").alias("matched"), _sorted("risks").alias("risks"))


@query(f"""WITH {_SCORED} SELECT 'anime:' || i AS item, s AS candidate, points AS score, CAST(rank AS INTEGER) AS rank, CAST(ahead AS INTEGER) AS lead, {_risks("CASE WHEN ahead < 12 THEN 'multiple_close_candidates' END, ")} AS risks,
  CASE WHEN conflict OR season < 0 THEN 'low' WHEN points >= 85 AND ahead >= 12 THEN 'high' WHEN points >= 65 THEN 'medium' ELSE 'low' END AS confidence,
  NOT conflict AND ((name AND (near OR site OR made)) OR (site AND (near OR made) AND score >= 55)) AND (ahead >= 15 OR (site AND (near OR made) AND score >= 55) OR (site AND made AND score >= 50)) AND (season >= 0 OR (site AND (near OR made) AND score >= 55))
  AND ((site AND (near OR made) AND score >= 55) OR (site AND made AND score >= 50 AND (name OR near)) OR (site AND near AND score >= 60) OR score >= 74 OR (score >= 66 AND near AND ahead >= 25)) AS accepted FROM final""")
def subject_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in rank, with what close ones cost, their confidence, and whether one may be bound without review."""
    ranked = match.finalized(_scored(spark, sf_dir))
    return ranked.select(F.col("i.id").alias("item"), F.col("s.id").alias("candidate"), F.col("final").alias("score"), "rank", "lead", _sorted("risks").alias("risks"), "confidence", match.accepted().alias("accepted"))
