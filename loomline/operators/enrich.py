"""What a subject adds to an item, and the batch flows that use it: enrichment, detail refresh, sync and reconciliation.

Which subject belongs to which item is decided by joins and scores; what it
adds is said column by column on the joined structs, as in :mod:`.merge`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as T
from ..functions import seasons as S
from ..functions import text as X
from ..sources.settled import settle
from . import match, merge, rules
from . import records as R
from .merge import Row

#: Columns of a subject (see snapshots.with_facts) that merging reads.
FACTS = ("id", "name", "name_cn", "date", "images", "eps", "total_episodes", "rating", "rank", "aliases")
#: Punctuation that reconciling takes out of titles (the third list of its kind).
_RECONCILE = re.compile("[!\"'`()\\[\\]{}<>.,:;?/　、。「」『』《》\\s_-]+")
#: Points by which one of several rows of a subject and season is kept.
KEEP_POINTS = (("YucWiki", 100), ("Bangumi", 20), ("YourAnimes", 10))


# Columns

def _positive(value: Column) -> Column:
    return F.when(value > 0, value)


def episodes_of(subject: Column) -> Column:
    return F.coalesce(_positive(subject["eps"]), _positive(subject["total_episodes"]))


def _page(number: Column) -> Column:
    return F.concat(F.lit("https://bgm.tv/subject/"), number.cast("string"))


def rating_of(subject: Column, at: str) -> Column:
    said = subject["rating"]
    rank = F.coalesce(_positive(subject["rank"]), _positive(said["rank"]))
    return F.struct(subject["id"].alias("subjectId"), _page(subject["id"]).alias("url"), _positive(said["score"]).alias("rating"), _positive(said["total"]).alias("ratingCount"), rank.alias("rank"), F.lit(at).alias("lastSyncedAt")).cast(T.RATING)


def cover_of(subject: Column) -> Column:
    images = subject["images"]
    sizes = {"large": ("large", "common"), "medium": ("medium", "common"), "small": ("small", "grid")}
    cover = F.struct(*(F.coalesce(images[a], images[b]).alias(f) for f, (a, b) in sizes.items()), F.lit("bangumi").alias("source"))
    return F.when(images.isNotNull(), cover.cast(T.COVER))


def source_of(subject: Column, at: str) -> Column:
    return F.struct(
        F.lit(merge.DATABASE).alias("name"), F.lit("bangumi").alias("type"), _page(subject["id"]).alias("url"), F.lit(at).alias("retrievedAt"), F.lit(None).cast("double").alias("confidence"), F.lit("metadata").alias("scope"),
    ).cast(T.SOURCE)


def _titled(item: Row, subject: Column) -> Column:
    title, none = item["title"], F.array().cast("array<string>")
    return F.struct(
        title["original"].alias("original"), F.coalesce(title["japanese"], subject["name"]).alias("japanese"), F.coalesce(title["chinese"], X.given(subject["name_cn"])).alias("chinese"), title["english"].alias("english"),
        X.ordered_union(F.coalesce(title["aliases"], none), F.coalesce(subject["aliases"], none)).alias("aliases"),
    )


def _outer(item: Row, subject: Column) -> Column:
    return F.struct(subject.cast("long").alias("bangumiSubjectId"), item["externalIds"]["bahamutSn"].alias("bahamutSn"))


def _bound(item: Row, subject: Column, at: str) -> dict[str, Column]:
    sources = merge.all_sources(item["sources"], F.array(source_of(subject, at)))
    return {**item, "externalIds": _outer(item, subject["id"]), "bangumi": rating_of(subject, at), "sources": sources, "updatedAt": F.lit(at)}


def add_subject(item: Row, subject: Column, at: str) -> dict[str, Column]:
    """An item with its subject's names, cover, rating and, where it has none, episode counts."""
    counts = {f: F.coalesce(item[f], episodes_of(subject)) for f in ("episodeCount", "airedEpisodeCount")}
    return {**_bound(item, subject, at), **counts, "title": _titled(item, subject), "coverImage": F.coalesce(cover_of(subject), item["coverImage"])}


def add_match(item: Row, subject: Column, confidence: Column, at: str) -> dict[str, Column]:
    """An item with a match of high confidence; any other match, or none, takes the subject away."""
    good = S.yes(confidence == "high") & subject.isNotNull()
    bound = {**_bound(item, subject, at), "title": _titled(item, subject), "coverImage": F.coalesce(item["coverImage"], cover_of(subject))}
    nothing = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T.RATING.fields))
    status = F.when(S.yes(item["dataStatus"] == "conflicting"), item["dataStatus"]).otherwise(F.lit("unverified"))
    bare = {**item, "bangumi": nothing, "externalIds": _outer(item, F.lit(None)), "dataStatus": status, "updatedAt": F.lit(at)}
    return {f: F.when(good, bound[f]).otherwise(bare[f]) for f in bound}


def fill_from_snapshot(item: Row, subject: Column, at: str) -> dict[str, Column]:
    """An item with what it doesn't know yet from a snapshot."""
    count, old, fresh = F.coalesce(item["episodeCount"], episodes_of(subject)), item["bangumi"], rating_of(subject, at)
    number = F.coalesce(merge.subject_of(item), subject["id"])
    news = episodes_of(subject).isNotNull() | old["rating"].isNull()
    rating = F.struct(
        number.alias("subjectId"), F.coalesce(old["url"], _page(number)).alias("url"), *(F.coalesce(old[f], fresh[f]).alias(f) for f in ("rating", "ratingCount", "rank")),
        F.when(news, F.lit(at)).otherwise(old["lastSyncedAt"]).alias("lastSyncedAt"),
    )
    aired = F.coalesce(item["airedEpisodeCount"], F.when(S.yes(item["status"] == "finished"), count))
    outer = _outer(item, F.coalesce(item["externalIds"]["bangumiSubjectId"], number))
    return {**item, "episodeCount": count, "airedEpisodeCount": aired, "externalIds": outer, "bangumi": rating, "updatedAt": F.when(news, F.lit(at)).otherwise(item["updatedAt"])}


def weekly(old: Column, start: Column, time: Column, episodes: Column, source: Column) -> Column:
    """A schedule of weekly episodes from the first known one on, if the slot and their number are known; else the one there is."""
    head = F.get(old, F.lit(0))
    first, number = F.coalesce(head["airDate"], start), F.when(head.isNotNull(), F.coalesce(head["episodeNumber"], F.lit(1))).otherwise(F.lit(1))
    was = lambda k: F.get(old, k)
    made = F.transform(F.sequence(F.lit(0), episodes - 1), lambda k: F.struct(
        (number + k).alias("episodeNumber"), was(k)["episodeTitle"].alias("episodeTitle"), S.shift(first, k * 7).alias("airDate"), time.alias("airTime"), F.lit(S.CHINA).alias("timezone"),
        F.lit("confirmed").alias("status"), source.alias("source"), was(k)["rawTimeText"].alias("rawTimeText"),
    ).cast(T.EPISODE))
    return F.when(S.yes(episodes > 1) & X.given(start).isNotNull() & X.given(time).isNotNull(), made).otherwise(old)


def overwrite_detail(item: Row, subject: Column, now: str) -> dict[str, Column]:
    """An item with a fresh detail: rating and cover anew, a weekly schedule, and the state that its days give."""
    n, old = F.coalesce(episodes_of(subject), item["episodeCount"]), item["schedule"]
    start = F.coalesce(item["startDate"], F.when(S.is_date(subject["date"]), subject["date"]))
    schedule = weekly(old, start, item["updateTime"], n, F.coalesce(F.get(old, F.lit(0))["source"], source_of(subject, now)))
    some = S.yes(F.size(schedule) > 0)
    # One day that stands for all of an unknown number of episodes is no end.
    single = n.isNull() & S.yes(item["endDate"] == item["startDate"]) & S.yes(F.size(old) <= 1)
    end = F.when(n.isNotNull() & some, F.element_at(schedule, -1)["airDate"]).when(~single, item["endDate"])
    aired = F.when(some, S.aired(F.transform(schedule, lambda e: e["airDate"]), F.lit(now[:10]), n))
    out = {
        **_bound(item, subject, now), "startDate": start, "endDate": end, "episodeCount": n, "airedEpisodeCount": aired, "primarySeason": S.primary_season(start), "schedule": schedule,
        "updateWeekday": S.update_weekday(item["updateWeekday"], schedule, start), "coverImage": F.coalesce(cover_of(subject), item["coverImage"]), "status": S.status_of(start, end, F.to_timestamp(F.lit(now)), 8),
    }
    return merge.no_final_slot(merge.in_seasons(out))


def retagged(item: Row) -> dict[str, Column]:
    """An item whose seasons follow from its days."""
    return merge.in_seasons({**item, "primarySeason": S.primary_season(item["startDate"])})


def reference_time(item: Row, reference: Column) -> dict[str, Column]:
    """An item that isn't final with the start and time of a reference (a struct, null if there is none)."""
    applies = reference.isNotNull() & ~merge.is_final(item["status"]) & reference["updateTime"].isNotNull() & S.yes(F.size(reference["schedule"]) > 0)
    source = F.get(reference["sources"], F.lit(0))
    timed = merge.retimed(item["schedule"], F.lit(0), reference["updateTime"], source)
    schedule = F.when(S.yes(F.size(item["schedule"]) > 0), timed).otherwise(F.slice(reference["schedule"], 1, 1))
    start = F.coalesce(reference["startDate"], item["startDate"])
    changed = merge.in_seasons({
        **item, "startDate": start, "primarySeason": F.coalesce(reference["primarySeason"], item["primarySeason"]), "updateWeekday": S.update_weekday(reference["updateWeekday"], schedule, start), "updateTime": reference["updateTime"],
        "timezone": F.lit(S.CHINA), "schedule": schedule, "sources": merge.all_sources(item["sources"], F.slice(reference["sources"], 1, 1)), "updatedAt": reference["updatedAt"],
    })
    return {f: c if c is item[f] else F.when(applies, c).otherwise(item[f]) for f, c in changed.items()}


# Flows

def _with_subject(items: DataFrame, found: DataFrame, function: Callable[[Row, Column], Row]) -> DataFrame:
    """Items (with ordinal) merged with their subject (found: id, subject as a struct); the others as they are."""
    both = items.join(found.select(F.col("id").alias("_id"), F.col("subject").alias("_subject")), F.col("id") == F.col("_id"), "left")
    own = merge.own()
    changed = F.when(F.col("_subject").isNotNull(), merge.packed(function(own, F.col("_subject")))).otherwise(merge.packed(own))
    return both.select(changed.alias("i"), F.col("ordinal").cast("long").alias("ordinal")).select("i.*", "ordinal")


def _facts(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + f).alias(f) for f in FACTS)).alias("subject")


def may_search() -> Column:
    """Eligible rows of a trusted source that have no subject."""
    trusted = rules.from_source("YucWiki") | S.yes(F.exists("sources", lambda s: S.yes((s["name"] == "YourAnimes") & (s["scope"] == "japan_broadcast"))))
    return trusted & rules.subject_id().isNull() & rules.eligible()


def may_refresh() -> Column:
    """Rows with a subject but without a rating, or with a cover from elsewhere."""
    return rules.subject_id().isNotNull() & (F.col("bangumi.rating").isNull() | ~S.yes(F.col("coverImage.source") == "bangumi"))


def snapshot_accepted() -> Column:
    """Whether a best candidate of the snapshots may be bound: stricter in its title than a search's."""
    has = lambda *fields: F.arrays_overlap("matched", F.array(*map(F.lit, fields)))
    doubts = lambda *names: F.arrays_overlap("risks", F.array(*map(F.lit, names)))
    title, site, made, day = has("name", "name_cn", "alias", "english"), has("officialUrl"), has("seasonToken", "episodeCount"), has("date", "quarter")
    arc = site & title & made & (F.col("score") >= 52)
    variant = site & title & (day | made) & (F.col("score") >= 56)
    good = title & (day | site | made) & ~doubts("format_conflict") & (~doubts("chinese_title_only", "alias_only") | variant) & (~doubts("year_mismatch", "date_conflict", "season_token_mismatch") | arc | variant)
    return good & ((F.col("lead") >= 12) | site) & (arc | variant | ((F.col("score") >= 74) & (F.col("lead") >= 15)))


def best_subjects(items: DataFrame, subjects: DataFrame, accept: Callable[[], Column]) -> DataFrame:
    """id and subject of items whose best candidate is accepted, or whose title is known by rule."""
    structs = items.select(F.struct(*items.columns).alias("i"))
    pairs = match.candidate_pairs(structs, subjects.select(F.struct(*subjects.columns).alias("s")))
    ranked = match.scored(pairs)
    w = Window.partitionBy(F.col("i.id")).orderBy(F.col("score").desc(), F.col("s.id"))
    best = ranked.withColumn("rank", F.row_number().over(w)).withColumn("lead", F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(100))).where("rank = 1").where(accept())
    found = best.select(F.col("i.id").alias("id"), _facts("s."))
    ruled = items.withColumn("_k", match.known_subject(F.col("title"), F.col("startDate"))).where(F.col("_k").isNotNull()).select("id", "_k")
    by_rule = ruled.join(subjects.select(F.col("id").alias("_k"), _facts()), "_k").select("id", "subject")
    return by_rule.unionByName(found.join(by_rule.select("id"), "id", "left_anti"))


def enrich_missing(items: DataFrame, subjects: DataFrame, at: str) -> DataFrame:
    """Items whose missing subject the candidates give, with it; the others as they are."""
    found = best_subjects(items.where(may_search()), subjects, match.accepted)
    return _with_subject(items, found, lambda i, s: add_subject(i, s, at))


def refresh_details(items: DataFrame, details: DataFrame, at: str) -> DataFrame:
    """Items whose rating or cover is missing, with their subject's detail."""
    wanted = items.where(may_refresh()).select("id", rules.subject_id().alias("_s"))
    found = wanted.join(details.select(F.col("id").alias("_s"), _facts()), "_s").select("id", "subject")
    return _with_subject(items, found, lambda i, s: add_subject(i, s, at))


def sync_details(items: DataFrame, details: DataFrame, snapshots: DataFrame, now: str) -> DataFrame:
    """Items over fresh details where there are some, else over snapshots, by subject or (catalogue rows) by match."""
    bound = items.select("id", rules.subject_id().alias("_s")).where("_s is not null")
    by_detail = bound.join(details.select(F.col("id").alias("_s"), _facts()), "_s").select("id", "subject")
    by_snapshot = bound.join(by_detail, "id", "left_anti").join(snapshots.select(F.col("id").alias("_s"), _facts()), "_s").select("id", "subject")
    loose = items.where(rules.subject_id().isNull() & rules.from_source(merge.CATALOGUE) & F.col("primarySeason").isNotNull())
    matched = best_subjects(loose, snapshots, snapshot_accepted)
    first = settle(_with_subject(items, by_detail, lambda i, s: overwrite_detail(i, s, now)))
    return _with_subject(first, by_snapshot.unionByName(matched), lambda i, s: fill_from_snapshot(i, s, now))


def reconcile_key(text: str) -> str:
    return _RECONCILE.sub("", unicodedata.normalize("NFKC", text).lower())


_reconcile_keys = X.array_udf(reconcile_key)


def keep_best(items: DataFrame) -> DataFrame:
    """Of several rows of a subject and season, the best known one; rows go by id."""
    score = F.lit(0)
    for name, points in KEEP_POINTS:
        score = score + F.when(rules.from_source(name), points).otherwise(0)
    score = score + F.when(F.startswith("id", F.lit("anime:yucwiki:")), 5).otherwise(0) + F.when(F.col("coverImage").isNotNull(), 2).otherwise(0) + F.when(F.col("bangumi.rating").isNotNull(), 2).otherwise(0)
    keyed = items.select("id", rules.subject_id().alias("subject"), S.season_order(F.col("primarySeason")).alias("season"), score.alias("score")).where("subject is not null and season is not null")
    best = R.keep_best(keyed, ["subject", "season"], F.col("score"), "id").select(F.col("id").alias("best"), "subject", "season")
    worse = keyed.join(best, ["subject", "season"]).where("id <> best").select("id").distinct()
    return items.join(worse, "id", "left_anti").select(*items.columns)


def reconcile(items: DataFrame, references: DataFrame, overrides: DataFrame, now: str) -> DataFrame:
    """The library over local references (items with ordinal) and manual slots: by subject, the last one; else by title, the first."""
    timed = references.where(F.col("updateTime").isNotNull()).select("ordinal", "bangumi", "title", merge.packed(merge.own()).alias("subject"))
    by_subject = R.last_by_key(timed.select(F.col("bangumi.subjectId").alias("_s"), "subject", "ordinal").where("_s is not null"), ["_s"], "ordinal").select("_s", "subject")
    keys = lambda d: d.withColumn("_k", F.explode(_reconcile_keys(X.titles_of(F.col("title")))))
    by_title = R.first_by_key(keys(timed).select("_k", "subject", "ordinal"), ["_k"], ["ordinal"]).select("_k", F.col("subject").alias("_t"))
    kept = items.where(rules.eligible())
    # Of the titles of an item the first one counts that a reference has.
    places = kept.select("id", F.posexplode(_reconcile_keys(X.titles_of(F.col("title")))).alias("place", "_k"))
    titled = places.join(by_title, "_k").groupBy("id").agg(F.min_by("_t", "place").alias("_t"))
    found = kept.select("id", F.col("bangumi.subjectId").alias("_s")).join(by_subject, "_s", "left").join(titled, "id", "left").select("id", F.coalesce("subject", "_t").alias("subject"))
    manual = overrides.select("id", F.struct(*overrides.columns).alias("subject"))
    tagged = settle(kept.select(merge.packed(retagged(merge.own())).alias("i"), "ordinal").select("i.*", "ordinal"))
    timed_rows = settle(_with_subject(tagged, found.where("subject is not null"), reference_time))
    # A manual slot counts for a row that has ended, too; its state stays, and with it the slot goes again.
    slotted = _with_subject(timed_rows, manual, lambda i, m: merge.overridden({**i, "status": F.lit("airing")}, m, now) | {"status": i["status"]})
    final = S.yes(F.col("status").isin(*merge.FINAL))
    return keep_best(settle(slotted.withColumns({c: F.when(~final, F.col(c)) for c in ("updateTime", "updateWeekday")})))


def snapshot_report(subjects: DataFrame) -> DataFrame:
    """Subjects of each month's snapshot, by month."""
    return subjects.groupBy("month").agg(F.countDistinct("id").alias("n")).orderBy("month")
