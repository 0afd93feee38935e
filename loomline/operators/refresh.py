"""Refreshing one season of the library: candidates in, the next library out.

The library may be large: of its rows only those are looked at that the
candidates name by id or title, and the others are filtered and unioned.
Candidates are cut down to the season and what may belong to it, and then
folded (:mod:`.merge`).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as T
from ..functions import seasons as S
from ..functions import text as X
from ..sources.library import LibraryError
from ..sources.settled import settle
from . import listing, merge, quality, rules
from . import records as R

#: Rows that a past season's catalogue has at least.
HISTORICAL_ROWS = 13


@dataclass
class Refreshed:
    """A refresh's results: the next library, the season's rows, and counts of what was done."""

    library: DataFrame
    season: DataFrame
    summary: dict[str, int]


def in_season(order: int) -> Column:
    return S.yes(S.season_order(F.col("primarySeason")) == order)


def reviewer() -> Column:
    return rules.from_source(*merge.REVIEWERS)


def catalogued() -> Column:
    return rules.from_source(merge.CATALOGUE, merge.DATABASE)


def trusted_start() -> Column:
    """A broadcast review that may begin a season without a catalogue."""
    scope = S.yes(F.exists("sources", lambda s: S.yes((s["name"] == "YourAnimes") & (s["scope"] == "japan_broadcast"))))
    return scope & S.yes(F.col("format") == "tv") & F.col("startDate").isNotNull() & S.yes(F.size("schedule") > 0)


def title_matches(items: DataFrame, old: DataFrame, same_season: bool) -> DataFrame:
    """For each candidate (id), the first eligible older row (match) that shares a title and no other subject."""
    sides = [d.select("id", "ordinal", rules.subject_id().alias("subject"), S.season_order(F.col("primarySeason")).alias("season"), X.merge_titles(X.titles_of(F.col("title"))).alias("keys")) for d in (items, old.where(rules.eligible()))]
    agree = F.coalesce(F.col("l.subject") == F.col("r.subject"), F.lit(True))
    agree = agree & S.yes(F.col("l.season") == F.col("r.season")) if same_season else agree
    return R.first_overlap(sides[0], sides[1], "id", "id", "keys", "ordinal", agree)


def _whole(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key and the whole item as a struct."""
    return rows.select(F.col("id").alias(key), merge.packed(merge.own()).alias(name))


def renewed(items: DataFrame, old: DataFrame, overrides: DataFrame, now: str) -> DataFrame:
    """Candidates (with ordinal) over what the library has of them, by id and else by title, and over manual slots."""
    reviews = items.where(reviewer())
    catalogue = items.where(~reviewer() & rules.from_source(merge.CATALOGUE))
    by_title = title_matches(reviews, old, False).unionByName(title_matches(catalogue, old, True))
    # Of the library, only the rows that are asked for are read in full.
    same = R.first_by_key(_whole(old.join(items.select("id"), "id", "left_semi"), "id", "old"), ["id"], ["old"])
    titled = _whole(old.join(by_title.select(F.col("match").alias("id")), "id", "left_semi"), "match", "titled")
    titled = by_title.join(R.first_by_key(titled, ["match"], ["titled"]), "match").select("id", "titled")
    base = _whole(items, "id", "item").join(items.select("id", "ordinal"), "id").join(same, "id", "left").join(titled, "id", "left")
    found = base.select(merge.renewed(F.col("item"), F.col("old"), F.col("titled")).alias("item"), F.col("ordinal").cast("long").alias("ordinal")).select("item.*", "ordinal")
    return slotted(settle(found), overrides, now)


def slotted(items: DataFrame, overrides: DataFrame, now: str) -> DataFrame:
    """Items (with ordinal) with the manual slots of their ids."""
    manual = overrides.select(F.col("id").alias("_id"), F.struct(*overrides.columns).alias("_manual"))
    both = items.join(manual, F.col("id") == F.col("_id"), "left")
    return both.select(merge.packed(merge.overridden(merge.own(), F.col("_manual"), now)).alias("i"), F.col("ordinal").cast("long").alias("ordinal")).select("i.*", "ordinal")


def related(items: DataFrame, order: int) -> DataFrame:
    """Candidates of a season, and those of others that share a title or a subject with one: what a fold may bring into it."""
    keyed = items.select("ordinal", in_season(order).alias("inside"), F.explode(F.array_append(
        X.merge_titles(X.titles_of(F.col("title"))), F.coalesce(F.concat(F.lit("subject:"), rules.subject_id().cast("string")), F.concat(F.lit("row:"), F.col("ordinal").cast("string"))))).alias("key"))
    wanted = keyed.join(keyed.where("inside").select("key"), "key", "left_semi").select("ordinal").distinct()
    return items.join(wanted, "ordinal", "left_semi").select(*items.columns)


def inherited(entries: DataFrame, old: DataFrame, order: int) -> DataFrame:
    """Older rows of the season that catalogue entries without a date (titleJapanese, titleChinese, url, retrievedAt) name."""
    rows = entries.withColumn("id", F.monotonically_increasing_id().cast("string")).withColumn("keys", X.merge_titles(F.filter(F.array("titleJapanese", "titleChinese"), lambda t: t.isNotNull())))
    own = old.where(in_season(order) & rules.eligible())
    keyed = own.select("id", "ordinal", X.merge_titles(X.titles_of(F.col("title"))).alias("keys"))
    match = R.first_overlap(rows, keyed, "id", "id", "keys", "ordinal")
    entry = rows.join(match, "id").groupBy("match").agg(F.min_by(F.struct("url", "retrievedAt"), F.col("id").cast("long")).alias("e"), F.min(F.col("id").cast("long")).alias("place"))
    source = F.struct(F.lit(merge.CATALOGUE).alias("name"), F.lit("third_party").alias("type"), F.col("e.url").alias("url"), F.col("e.retrievedAt").alias("retrievedAt"), F.lit(0.7).alias("confidence"), F.lit("japan_broadcast").alias("scope"))
    both = own.drop("ordinal").join(entry.withColumnRenamed("match", "id"), "id")
    present = F.exists("sources", lambda s: (s["name"] == source["name"]) & (s["type"] == source["type"]) & s["url"].eqNullSafe(source["url"]))
    return both.withColumn("sources", F.when(present, F.col("sources")).otherwise(F.array_append("sources", source))).withColumn("updatedAt", F.col("e.retrievedAt")).withColumn("ordinal", F.col("place")).select(*T.ITEM.fieldNames(), "ordinal")


def refresh_season(library: DataFrame, candidates: DataFrame, overrides: DataFrame, year: int, month: int, now: datetime, warnings: DataFrame | None = None, unscheduled: DataFrame | None = None) -> Refreshed:
    """Replace one season of the library (items with ``ordinal``) by what candidates (items with ``ordinal``) give.

    Raises :class:`LibraryError` where the candidates are too poor to replace
    what is there, or the result has errors.
    """
    spark = library.sparkSession
    year, quarter = listing.asked_season(year, month)
    order, stamp = year * 12 + month, now.isoformat()
    fold = lambda rows: merge.fold_items(rows, block=F.lit(order))
    fresh = candidates.select(merge.packed(merge.normal(merge.own(), stamp)).alias("i"), F.col("ordinal").cast("long").alias("ordinal")).select("i.*", "ordinal")
    season = settle(fold(related(settle(fresh), order)).where(in_season(order)))
    good = season.where(rules.eligible())
    has_primary, has_catalogue = (not good.where(c).isEmpty() for c in (rules.from_source(merge.CATALOGUE), catalogued()))
    secondary = F.lit(has_primary) & rules.from_source(merge.DATABASE) & ~rules.from_source(merge.CATALOGUE)
    alone = reviewer() & ~catalogued() & rules.subject_id().isNull()
    target = season.where(~secondary)
    if has_catalogue:
        target = target.where(~alone)
    else:
        matched = title_matches(target.where(alone), library, False).select("id")
        target = target.where(~alone | trusted_start()).unionByName(target.where(alone & ~trusted_start()).join(matched, "id", "left_semi").select(*target.columns))
    cold = lambda c, a, b: F.when(alone & (F.col(c) == a), F.lit(b)).otherwise(F.col(c))
    target = settle(target.withColumns({"inclusionStatus": cold("inclusionStatus", "included", "needs_review"), "dataStatus": cold("dataStatus", "complete", "partial")}))
    kept = target.where(rules.eligible())
    if unscheduled is not None:
        back = inherited(unscheduled, library, order).withColumn("ordinal", F.col("ordinal").cast("long") + F.lit(1 << 40))
        kept = kept.unionByName(back)
    kept = settle(fold(kept))
    past = library.where(in_season(order) & rules.eligible())
    _gates(kept, past, warnings, order, now)
    if kept.where(catalogued()).isEmpty():
        kept = settle(fold(past.withColumn("ordinal", F.col("ordinal").cast("long") - F.lit(1 << 40)).select(*kept.columns).unionByName(kept)))
    done = settle(fold(settle(renewed(kept, library, overrides, stamp))))
    slot = S.yes(F.col("status").isin(*merge.FINAL))
    old = library.select(*T.ITEM.fieldNames(), F.col("ordinal").cast("long").alias("ordinal"))
    merged = R.replace_partition(old, done.withColumn("ordinal", F.col("ordinal") + F.lit(1 << 41)), "id", in_season(order))
    merged = merged.withColumns({c: F.when(~slot, F.col(c)) for c in ("updateTime", "updateWeekday")})
    # The season's rows are what is new; of the others, which were valid before, only a repeated id can be wrong.
    problems = quality.issues(done).unionByName(quality.repeated_ids(merged))
    if quality.blocking(problems):
        raise LibraryError("CACHE_VALIDATION_FAILED", "the new library has errors", problems.where("severity = 'error'").limit(100).collect())
    return Refreshed(merged, done, summary(done, merged, target))


def _gates(kept: DataFrame, past: DataFrame, warnings: DataFrame | None, order: int, now: datetime) -> None:
    """Stop where a source's failure would replace a season by less."""
    today = F.first(S.primary_order(F.lit(now.date().isoformat())))
    n, primary, bound = kept.agg(F.count(F.lit(1)), F.count_if(rules.from_source(merge.CATALOGUE)), F.count_if(rules.subject_id().isNotNull())).first()
    current = kept.sparkSession.range(1).agg(today).first()[0]
    said = [] if warnings is None else [(w["source"], w["code"]) for w in warnings.select("source", "code").distinct().limit(1000).collect()]
    over = order < current
    failed = any(s == merge.CATALOGUE and c != "SOURCE_DISABLED" for s, c in said)
    weak = over and n < HISTORICAL_ROWS and (primary or failed)
    bare = over and n >= HISTORICAL_ROWS and primary and not bound and any(s == merge.DATABASE for s, _ in said)
    if weak or bare or (said and not n and past.isEmpty()):
        raise LibraryError("SOURCE_UNAVAILABLE", "the sources did not give enough to replace the season", said)


def summary(done: DataFrame, merged: DataFrame, target: DataFrame) -> dict[str, int]:
    """Counts of a refresh: of the season's rows, of the new library, and of candidates that did not qualify."""
    matched = F.col("bangumi.subjectId").isNotNull()
    row = done.agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(matched).alias("matchedBangumi"), F.count_if(~matched).alias("missingBangumi"), F.count_if(F.col("bangumi.rating").isNull()).alias("missingRating"),
        F.count_if(F.col("dataStatus") == "conflicting").alias("conflicting"), F.count_if(F.col("dataStatus") != "complete").alias("incomplete"),
    ).first()
    return {**row.asDict(), "skippedNonJapanese": target.where(~rules.eligible()).count(), "written": merged.count()}
