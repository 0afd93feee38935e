"""Merging items of several sources into one: survivorship by column, and the fold that finds duplicates.

Two rows that joins have brought together are two structs.  A merge says for
each column of the result which side it comes from; what is not said comes
from one of the sides as a whole.  Which rows of one season are the same title
depends on their order and is settled on titles and ids alone (:func:`placed`);
the rows themselves are then reduced group by group, as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as T
from ..functions import seasons as S
from ..functions import text as X
from . import records as R

#: An item's columns by name.
Row = Mapping[str, Column]

#: Columns in which the left row comes first.
LEFT_FIRST = ("startDate", "endDate", "primarySeason", "officialUrl", "coverImage", "episodeCount", "airedEpisodeCount", "updateTime")
#: Columns that a catalogue's row takes from others where it has none.
FILLED = ("coverImage", "episodeCount", "airedEpisodeCount")
#: Names of sources by their role, and states that end a row.
CATALOGUE, DATABASE = "YucWiki", "Bangumi"
REVIEWERS = ("Bahamut Anime Crazy", "YourAnimes")
FINAL = ("finished", "cancelled")

_TITLES = ("original", "japanese", "chinese", "english")
_SOURCES, _EPISODES, _TEXTS = T.T.ArrayType(T.SOURCE), T.T.ArrayType(T.EPISODE), T.T.ArrayType(T.T.StringType())


# Structs and arrays

def row(value: Column) -> dict[str, Column]:
    """The columns of an item that is one struct."""
    return {f: value[f] for f in T.ITEM.fieldNames()}


def own() -> dict[str, Column]:
    """The columns of items as they stand in a DataFrame."""
    return {f: F.col(f) for f in T.ITEM.fieldNames()}


def packed(columns: Row) -> Column:
    """An item's columns as one struct."""
    return F.struct(*(columns[f.name].cast(f.dataType).alias(f.name) for f in T.ITEM.fields))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _list(value: Column, kind: T.T.ArrayType) -> Column:
    return F.coalesce(value, F.array().cast(kind))


def first_by(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Elements of an array without those whose key came before."""
    return let(F.transform(rows, key), lambda keys: F.filter(rows, lambda x, i: F.array_position(keys, key(x)) == i + 1))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def all_sources(*lists: Column) -> Column:
    """Sources of all lists; of those equal in name, kind and address the first."""
    return first_by(F.concat(*(_list(x, _SOURCES) for x in lists)), lambda s: _joined(s["name"], s["type"], s["url"]))


def by_day(schedule: Column) -> Column:
    """A schedule without repeated entries, in the order of its days."""
    once = first_by(_list(schedule, _EPISODES), lambda e: _joined(e["episodeNumber"], e["airDate"], e["airTime"]))
    return F.array_sort(once, lambda a, b: F.when(a["airDate"] < b["airDate"], F.lit(-1)).when(a["airDate"] > b["airDate"], F.lit(1)).otherwise(F.lit(0)))


def with_old_times(incoming: Column, old: Column) -> Column:
    """Entries that an older schedule has with a time stay as they were there."""
    timed = F.filter(old, lambda e: e["airTime"].isNotNull())
    before = lambda e: F.filter(timed, lambda o: o["episodeNumber"].eqNullSafe(e["episodeNumber"]) & o["airDate"].eqNullSafe(e["airDate"]))
    return F.when(S.yes(F.size(old) > 0), by_day(F.transform(incoming, lambda e: F.coalesce(F.try_element_at(before(e), F.lit(-1)), e)))).otherwise(incoming)


def retimed(schedule: Column, by: Column, time: Column, source: Column | None, note: Column | None = None) -> Column:
    """A schedule moved by days, at a time in China, said by a source (by its own where that is null)."""
    return F.transform(_list(schedule, _EPISODES), lambda e: F.struct(
        e["episodeNumber"].alias("episodeNumber"), e["episodeTitle"].alias("episodeTitle"), S.shift(e["airDate"], by).alias("airDate"), time.alias("airTime"), F.lit(S.CHINA).alias("timezone"),
        e["status"].alias("status"), (e["source"] if source is None else F.coalesce(source, e["source"])).alias("source"),
        (e["rawTimeText"] if note is None else F.coalesce(note, e["rawTimeText"])).alias("rawTimeText"),
    ).cast(T.EPISODE))


# What items say

def from_source(item: Row, *names: str) -> Column:
    return S.yes(F.exists(item["sources"], lambda s: S.yes(s["name"].isin(*names))))


def reviews_broadcast(item: Row) -> Column:
    return S.yes(F.exists(item["sources"], lambda s: S.yes((s["name"] == "YourAnimes") & (s["scope"] == "japan_broadcast"))))


def subject_of(item: Row) -> Column:
    return F.coalesce(item["bangumi"]["subjectId"], item["externalIds"]["bangumiSubjectId"])


def is_final(status: Column) -> Column:
    return S.yes(status.isin(*FINAL))


def no_final_slot(item: Row) -> dict[str, Column]:
    """A row that has ended has no weekly slot."""
    return {**item, **{f: F.when(~is_final(item["status"]), item[f]) for f in ("updateTime", "updateWeekday")}}


def in_seasons(item: Row) -> dict[str, Column]:
    """The seasons that a row's schedule lies in, from its schedule and primary season."""
    return {**item, "activeSeasons": S.active_seasons(item["schedule"], item["primarySeason"])}


# Parts that several merges share

def _identified(first: Row, second: Row) -> dict[str, Column]:
    """Id, rating and outer ids: those of the first row's subject, if it has one."""
    bound = first["bangumi"]["subjectId"].isNotNull()
    subject = F.when(bound, first["bangumi"]["subjectId"]).otherwise(second["bangumi"]["subjectId"])
    outer = F.struct(*(F.coalesce(first["externalIds"][f], second["externalIds"][f]).alias(f) for f in T.EXTERNAL.fieldNames()))
    name = F.coalesce(F.concat(F.lit("anime:"), subject.cast("string")), first["id"])
    return {"id": name, "bangumi": F.when(bound, first["bangumi"]).otherwise(second["bangumi"]), "externalIds": outer}


def _title(forms: Mapping[str, Column], *aliases: Column) -> Column:
    return F.struct(*(forms[f].alias(f) for f in _TITLES), X.ordered_union(*(_list(a, _TEXTS) for a in aliases)).alias("aliases"))


def _slot(item: Row, old: Row, status: Column) -> dict[str, Column]:
    """The slot of a row and of its older version, which fills in where the new one has no time."""
    timed, ended = item["updateTime"].isNotNull(), is_final(status)
    zone = F.when(~ended & ~timed & old["updateTime"].isNotNull(), old["timezone"]).otherwise(item["timezone"])
    day = F.when(timed, item["updateWeekday"]).otherwise(F.coalesce(old["updateWeekday"], item["updateWeekday"]))
    return {"updateWeekday": F.when(~ended, day), "updateTime": F.when(~ended, F.coalesce(item["updateTime"], old["updateTime"])), "timezone": zone}


# Merges

def with_database(primary: Row, subject: Row) -> dict[str, Column]:
    """A catalogue's row with a database's ids, ratings, covers, counts and aliases; all else is the catalogue's."""
    title = _title({f: primary["title"][f] for f in _TITLES}, primary["title"]["aliases"], subject["title"]["aliases"])
    filled = {f: F.coalesce(primary[f], subject[f]) for f in FILLED}
    return no_final_slot({**primary, **_identified(primary, subject), **filled, "title": title, "sources": all_sources(primary["sources"], subject["sources"]), "updatedAt": subject["updatedAt"]})


def united(left: Row, right: Row) -> dict[str, Column]:
    """Two rows of one title: LEFT_FIRST are the left's where it has them, most others the right's."""
    forms = {f: F.coalesce(left["title"][f], right["title"][f]) for f in _TITLES} | {"original": F.coalesce(X.given(left["title"]["original"]), right["title"]["original"])}
    status = R.merged_status(left["status"], right["status"])
    # A reviewed broadcast gives the better start; if it has a time, the schedule moves along.
    better = ~is_final(status) & reviews_broadcast(right) & right["startDate"].isNotNull()
    moves = better & right["updateTime"].isNotNull()
    one = F.when(S.yes(F.size(left["schedule"]) > 0), left["schedule"]).otherwise(right["schedule"])
    again = retimed(one, S.days_between(left["startDate"], right["startDate"]), right["updateTime"], F.get(right["sources"], F.lit(0)))
    out = {
        **right, **{f: F.coalesce(left[f], right[f]) for f in LEFT_FIRST}, **_identified(left, right),
        "title": _title(forms, left["title"]["aliases"], right["title"]["aliases"]), "status": status, "createdAt": left["createdAt"],
        "format": F.when(left["format"] != "unknown", left["format"]).otherwise(right["format"]), "exclusionReason": F.coalesce(right["exclusionReason"], left["exclusionReason"]),
        "sources": all_sources(left["sources"], right["sources"]), "schedule": by_day(F.when(moves, again).otherwise(F.concat(_list(left["schedule"], _EPISODES), _list(right["schedule"], _EPISODES)))),
    }
    out |= {f: F.when(better, right[f]).otherwise(out[f]) for f in ("startDate", "primarySeason")}
    out["updateWeekday"] = S.update_weekday(F.coalesce(right["updateWeekday"], left["updateWeekday"]), out["schedule"], out["startDate"])
    return no_final_slot(in_seasons(out))


def merged(left: Column, right: Column) -> Column:
    """Two rows of one title, as structs."""
    a, b = row(left), row(right)
    return F.when(from_source(a, CATALOGUE) & from_source(b, DATABASE), packed(with_database(a, b))).otherwise(packed(united(a, b)))


def _over(item: Row, old: Row) -> dict[str, Column]:
    """What a newer row keeps of an older one, however it was found."""
    status = R.merged_status(item["status"], old["status"])
    return {**item, **_slot(item, old, status), "status": status, "createdAt": old["createdAt"], "schedule": with_old_times(item["schedule"], old["schedule"]), "sources": all_sources(old["sources"], item["sources"])}


def over_same_id(item: Row, old: Row) -> dict[str, Column]:
    """A row over its older version; a rating of the same subject stays if there is no newer one."""
    stays = item["bangumi"]["rating"].isNull() & item["bangumi"]["subjectId"].eqNullSafe(old["bangumi"]["subjectId"])
    return {**_over(item, old), "bangumi": F.when(stays, old["bangumi"]).otherwise(item["bangumi"])}


def over_same_title(item: Row, old: Row) -> dict[str, Column]:
    """A catalogue's row over the older one that its title finds, whose subject, cover and counts it keeps."""
    return {**_over(item, old), **_identified(item, old), **{f: F.coalesce(item[f], old[f]) for f in FILLED}}


def reviewed(old: Column, item: Column) -> Column:
    """A schedule's row over the row that it speaks of, as structs: its slot wins."""
    new = row(item)

    def finish(both: Column) -> Column:
        out = row(both)
        partial = S.yes(out["dataStatus"] == "complete") & ~S.yes(new["dataStatus"] == "complete")
        slot = {f: F.coalesce(new[f], out[f]) for f in ("updateTime", "updateWeekday")}
        zone = F.when(~is_final(out["status"]) & new["updateTime"].isNotNull(), new["timezone"]).otherwise(out["timezone"])
        return packed(no_final_slot({**out, **slot, "timezone": zone, "dataStatus": F.when(partial, F.lit("partial")).otherwise(out["dataStatus"])}))

    return let(merged(old, item), finish)


def renewed(item: Column, by_id: Column, by_title: Column) -> Column:
    """A candidate over what the library has of it (structs, null where nothing was found): by id, else by title."""
    new, old = row(item), F.coalesce(by_id, by_title)
    return (
        F.when(from_source(new, *REVIEWERS), F.when(old.isNotNull(), reviewed(old, item)).otherwise(item))
        .when(by_id.isNotNull(), packed(over_same_id(new, row(by_id))))
        .when(by_title.isNotNull() & from_source(new, CATALOGUE), packed(over_same_title(new, row(by_title))))
        .otherwise(item)
    )


def overridden(item: Row, manual: Column, at: str) -> dict[str, Column]:
    """Columns of an item with a manual slot (a struct, null if there is none); a row that has ended stays."""
    source = F.struct(
        manual["sourceName"].alias("name"), F.lit("manual").alias("type"), manual["sourceUrl"].alias("url"), F.lit(at).alias("retrievedAt"), F.lit(0.95).alias("confidence"), F.lit("japan_broadcast").alias("scope"),
    ).cast(T.SOURCE)
    start = manual["beijingDate"]
    first = F.struct(
        F.lit(1).alias("episodeNumber"), F.lit(None).cast("string").alias("episodeTitle"), start.alias("airDate"), manual["beijingTime"].alias("airTime"), F.lit(S.CHINA).alias("timezone"),
        F.lit("confirmed").alias("status"), source.alias("source"), manual["note"].alias("rawTimeText"),
    ).cast(T.EPISODE)
    moved = by_day(retimed(item["schedule"], S.days_between(item["startDate"], start), manual["beijingTime"], source, manual["note"]))
    schedule = F.when(S.yes(F.size(item["schedule"]) > 0), moved).otherwise(F.array(first))
    changed = in_seasons({
        **item, "startDate": start, "primarySeason": S.primary_season(start), "schedule": schedule, "updateWeekday": S.update_weekday(F.lit(None).cast("int"), schedule, start), "updateTime": manual["beijingTime"],
        "timezone": F.lit(S.CHINA), "sources": all_sources(item["sources"], F.array(source)), "dataStatus": F.when(S.yes(item["dataStatus"] == "complete"), item["dataStatus"]).otherwise(F.lit("partial")), "updatedAt": F.lit(at),
    })
    applies = manual.isNotNull() & ~is_final(item["status"])
    return {f: c if c is item[f] else F.when(applies, c).otherwise(item[f]) for f, c in changed.items()}


def normal(item: Row, at: str) -> dict[str, Column]:
    """Columns of a fetched row with those that follow from others made new."""
    bare = S.yes(item["dataStatus"] == "complete") & ~S.yes(F.size(item["schedule"]) > 0)
    out = {
        **item, "title": _title({f: item["title"][f] for f in _TITLES}, item["title"]["aliases"]), "primarySeason": S.primary_season(item["startDate"]), "schedule": _list(item["schedule"], _EPISODES),
        "updateWeekday": S.update_weekday(item["updateWeekday"], item["schedule"], item["startDate"]), "dataStatus": F.when(bare, F.lit("partial")).otherwise(item["dataStatus"]),
        **{f: F.coalesce(X.given(item[f]), F.lit(at)) for f in ("updatedAt", "createdAt")},
    }
    return no_final_slot(in_seasons(out))


# The fold

class _Place:
    """What decides whether a later row belongs to a place: titles, names of sources, subject."""

    def __init__(self, seen: Mapping):
        self.titles = dict(zip(_TITLES, seen["titles"], strict=True))
        self.aliases, self.names, self.subject = list(seen["aliases"]), set(seen["names"]), seen["subject"]

    def keys(self, aliases: bool) -> set[str]:
        forms = [*self.titles.values(), *(self.aliases if aliases else ())]
        return {k for f in forms if f and X.trimmed(f) for k in [X.merge_key(f)] if k}

    def take(self, other: _Place) -> None:
        if not (CATALOGUE in self.names and DATABASE in other.names):  # a database adds no names to a catalogue's row
            for form, text in self.titles.items():
                if text is None or (form == "original" and text == ""):
                    self.titles[form] = other.titles[form]
        self.aliases += other.aliases
        self.names |= other.names
        self.subject = other.subject if self.subject is None else self.subject


def _place_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Number the places of one block's rows, in the order in which they come up.

    A row with a subject joins the first catalogue's place that has one of its
    titles, a reviewer's row the first place with a subject or from the database
    that has one of its titles or aliases; others, and those that find none,
    the place of the same subject, or title, start and format.  Places are
    found by an index of their titles.
    """
    places: list[_Place] = []
    by_name: dict[str, int] = {}
    by_title: dict[str, list[int]] = {}
    numbers = []
    rows = rows.sort_values("ordinal", kind="stable")
    for seen in rows.to_dict("records"):
        seen["subject"] = None if pd.isna(seen["subject"]) else int(seen["subject"])
        here, at = _Place(seen), None
        reviews = seen["subject"] is None and not here.names.isdisjoint(REVIEWERS)
        if reviews or seen["subject"] is not None:
            keys = here.keys(reviews)
            for k in sorted({p for key in keys for p in by_title.get(key, ())}):
                there = places[k]
                open_ = (there.subject is not None or DATABASE in there.names) if reviews else CATALOGUE in there.names
                if open_ and not keys.isdisjoint(there.keys(reviews)):
                    at = k
                    break
        if at is None:
            # A place keeps the name that it was made with.
            name = f"bangumi:{seen['subject']}" if seen["subject"] is not None else f"title:{X.identity_key(seen['titles'][0])}:{seen['start']}:{seen['format']}"
            at = by_name.setdefault(name, len(places))
        if at == len(places):
            places.append(here)
        else:
            places[at].take(here)
        for key in places[at].keys(True):
            if at not in by_title.setdefault(key, []):
                by_title[key].append(at)
        numbers.append(at)
    return pd.DataFrame({"block": rows["block"], "ordinal": rows["ordinal"], "place": numbers})


def placed(items: DataFrame, block: Column, order: str) -> DataFrame:
    """block, ordinal and place of each item: items of a block with one place are one title.

    A block is a season's candidates.  Its rows go to one task as titles and
    ids, some hundred bytes each; a row may change what the next one finds.
    """
    title = F.col("title")
    light = items.select(
        block.cast("long").alias("block"), F.col(order).cast("long").alias("ordinal"), F.array(*(title[f] for f in _TITLES)).alias("titles"), _list(title["aliases"], _TEXTS).alias("aliases"),
        F.transform(_list(F.col("sources"), _SOURCES), lambda s: s["name"]).alias("names"), subject_of(own()).alias("subject"), F.coalesce("startDate", F.lit("")).alias("start"), "format",
    )
    return light.groupBy("block").applyInPandas(_place_rows, "block long, ordinal long, place long")


def fold_items(items: DataFrame, order: str = "ordinal", block: Column | None = None) -> DataFrame:
    """Items with duplicates merged in their order (column ``order``, unique within a block), which is that of the places afterwards.

    Blocks (the primary season, unless another is given) are folded each on its own.
    """
    block = S.season_order(F.col("primarySeason")) if block is None else block
    rows = items.select(F.coalesce(block.cast("long"), F.lit(-1)).alias("block"), F.col(order).cast("long").alias("ordinal"), packed(own()).alias("item"))
    where = placed(items, F.coalesce(block.cast("long"), F.lit(-1)), order)
    groups = rows.join(where, ["block", "ordinal"]).groupBy("block", "place").agg(F.array_sort(F.collect_list(F.struct("ordinal", "item"))).alias("rows"))
    later = F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: r["item"])
    one = F.aggregate(later, F.get("rows", F.lit(0))["item"], merged)
    return groups.select(F.when(F.size("rows") > 1, one).otherwise(F.get("rows", F.lit(0))["item"]).alias("i"), F.col("place").alias(order)).select("i.*", order)
