"""Matching items with subjects: blocking, scores from many features, ranks with margins, and acceptance.

Pairs come from a join on blocking keys.  What a row brings to its pairs is
worked out before they are made, and pairs carry nothing else; each feature is
a column, its points add up, and what it found or doubts is kept in two
arrays.  Only the comparison of titles is an Arrow function.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, titles
from ..functions import seasons as S
from ..functions import text as X

#: Thresholds of confidence, and formats that exclude each other.
HIGH, MEDIUM = 85, 65
HARD_FORMATS = ("tv", "web", "movie", "sp", "ova", "recap", "pv", "cm", "music_video")

_EVIDENCE = T.StructType([T.StructField("points", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("season", T.IntegerType()), T.StructField("says", T.StringType())])
#: Kinds of blocking keys; those of a season sort before those of a title.
_MONTH, _TITLE = "m:", "t:"


@F.pandas_udf(_EVIDENCE)
def _title_evidence(mine: pd.Series, other: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([titles.evidence(titles.side(a), titles.side(b)) for a, b in zip(mine, other, strict=True)], columns=["points", "field", "season", "says"])


@F.pandas_udf(T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("forms", T.StringType())]))
def _read_titles(entries: pd.Series) -> pd.DataFrame:
    """Blocking keys of a row's entries, and the forms of its titles for :func:`_title_evidence`."""
    said = [[(e["field"], e["raw"]) for e in json.loads(texts or "[]")] for texts in entries]
    return pd.DataFrame([(sorted({_TITLE + k for _, raw in row for k in titles.normal(raw).same}), titles.written(row)) for row in said], columns=["keys", "forms"])


def _entry(field: str, raw: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), raw.alias("raw"))


def _filled(entries: Column) -> Column:
    return F.filter(entries, lambda e: S.yes(F.length(X.trim(e["raw"])) > 0))


def item_titles(title: Column) -> Column:
    """(field, raw) entries of an item's title."""
    own = [_entry(f, title[f]) for f in ("original", "japanese", "chinese", "english")]
    return _filled(F.concat(F.array(*own), F.transform(F.coalesce(title["aliases"], F.array().cast("array<string>")), lambda a: _entry("alias", a))))


def subject_titles(name: Column, name_cn: Column, aliases: Column) -> Column:
    return _filled(F.concat(F.array(_entry("japanese", name), _entry("chinese", name_cn)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: _entry("alias", a))))


def _item_entries(i: Column) -> Column:
    return F.to_json(item_titles(i["title"]))


def _subject_entries(s: Column) -> Column:
    return F.to_json(subject_titles(s["name"], s["name_cn"], s["aliases"]))


def platform_format(platform: Column) -> Column:
    """Format that a platform's name says."""
    p = F.lower(F.coalesce(platform, F.lit("")))
    out = F.lit("unknown")
    for found, words in (("sp", ("sp", "special")), ("movie", ("movie", "剧场", "映画")), ("ova", ("ova", "oad")), ("web", ("web", "ona", "网络")), ("tv", ("tv",))):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(p, F.lit(word))
        out = F.when(hit, F.lit(found)).otherwise(out)
    return out


def _url(text: Column) -> Column:
    return F.lower(F.regexp_replace(X.trim(text), "/$", ""))


#: A case of a feature: (condition, points, field, risk); the first that holds counts.
Case = tuple[Column, int, str | None, str | None]


def _case(cases: list[Case]) -> Column:
    """Number of the first case that holds, from 0; one more than the last if none does."""
    out = F.lit(len(cases))
    for n, (when, *_) in reversed(list(enumerate(cases))):
        out = F.when(S.yes(when), F.lit(n)).otherwise(out)
    return out


def _of_case(case: Column, values: list, kind: str) -> Column:
    return F.get(F.array(*(F.lit(v).cast(kind) for v in [*values, 0 if kind == "int" else None])), case)


def _present(*values: Column) -> Column:
    """Those that are not null, each once."""
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def item_facts(i: Column, forms: Column) -> Column:
    """What matching reads of an item (forms: of its titles), worked out once and not for each of its pairs."""
    kind = lambda *names: F.exists(i["sources"], lambda x: S.yes(x["type"].isin(*names)))
    weak = (F.size(i["sources"]) > 0) & F.forall(i["sources"], lambda x: S.yes(x["type"].isin("third_party", "streaming_platform"))) & F.exists(i["sources"], lambda x: X.matches(x["name"], "bahamut|巴哈|gamer|yucwiki|yuc|長門|长门"))
    facts = {
        "id": i["id"], "titles": forms, "start": S.date_of(i["startDate"]), "year": i["primarySeason"]["year"], "quarter": i["primarySeason"]["quarter"], "format": i["format"],
        "episodes": i["episodeCount"], "site": _url(i["officialUrl"]), "studios": X.merge_titles(F.coalesce(i["staff"]["studio"], F.array().cast("array<string>"))),
        "spoken": S.yes(kind("official", "tv_station")), "guessed": S.yes(kind("ai_inferred")), "weak": S.yes(weak),
    }
    return F.struct(*(c.alias(k) for k, c in facts.items()))


def subject_facts(s: Column, forms: Column) -> Column:
    """What matching reads of a subject with aliases, sites, studios."""
    facts = {
        "id": s["id"], "type": s["type"], "titles": forms, "date": S.date_of(s["date"]), "format": platform_format(s["platform"]),
        "episodes": F.coalesce(F.when(s["eps"] > 0, s["eps"]), F.when(s["total_episodes"] > 0, s["total_episodes"])), "sites": F.transform(s["sites"], _url), "studios": X.merge_titles(s["studios"]),
    }
    return F.struct(*(c.alias(k) for k, c in facts.items()))


def date_cases(mine: Column, theirs: Column, year: Column, quarter: Column) -> list[Case]:
    gap = F.abs(F.datediff(theirs, mine))
    wrong_year = year.isNotNull() & (F.year(theirs) != year)
    same_quarter = F.quarter(mine) == F.quarter(theirs)
    no_start = mine.isNull()
    return [
        (theirs.isNull(), 2, None, "date_missing"),
        (no_start & wrong_year, -25, None, "year_mismatch"),
        (no_start & year.isNotNull() & (S.month_quarter(F.month(theirs)) == quarter), 8, "quarter", None),
        (no_start, 0, None, None),
        (gap == 0, 20, "date", None),
        (gap <= 7, 16, "date", None),
        (F.trunc(mine, "month") == F.trunc(theirs, "month"), 12, "date", None),
        (wrong_year, -25, None, "year_mismatch"),
        (same_quarter, 8, "quarter", None),
        (gap > 90, -18, None, "date_conflict"),
    ]


def features(i: Column, s: Column, from_month: Column) -> list[list[Case]]:
    """Features of pairs of facts, besides titles."""
    known = S.yes(i["format"] != "unknown") & (s["format"] != "unknown")
    return [
        date_cases(i["start"], s["date"], i["year"], i["quarter"]),
        [(s["type"] == 2, 8, None, None), (F.lit(True), -45, None, "format_conflict")],
        [(known & (i["format"] == s["format"]), 5, "format", None), (known & i["format"].isin(*HARD_FORMATS) & s["format"].isin(*HARD_FORMATS), -15, None, "format_conflict")],
        [(i["episodes"].isNull() | s["episodes"].isNull(), 2, None, None), (i["episodes"] == s["episodes"], 7, "episodeCount", None), (F.abs(i["episodes"] - s["episodes"]) >= 3, -8, None, None), (F.lit(True), -3, None, None)],
        [(F.array_contains(s["sites"], i["site"]), 22, "officialUrl", None)],
        [(F.arrays_overlap(i["studios"], s["studios"]), 4, "studio", None)],
        [(from_month, 6, None, None)],
        [(i["spoken"], 5, None, None), (i["guessed"], -10, None, "weak_source"), (i["weak"], -6, None, "weak_source")],
    ]


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs (i, s, from_month) with score, matched (fields) and risks; facts are made here for pairs that come without."""
    if "_i" not in pairs.columns:
        i, s = F.col("i"), F.col("s")
        read = pairs.withColumns({"_a": _read_titles(_item_entries(i)), "_b": _read_titles(_subject_entries(s))})
        pairs = read.withColumns({"_i": item_facts(i, F.col("_a.forms")), "_s": subject_facts(s, F.col("_b.forms"))}).drop("_a", "_b")
    found = features(F.col("_i"), F.col("_s"), F.col("from_month"))
    rows = pairs.withColumns({"_ev": _title_evidence("_i.titles", "_s.titles"), **{f"_{n}": _case(cases) for n, cases in enumerate(found)}}).drop("_i", "_s")
    said = lambda k, kind: [_of_case(F.col(f"_{n}"), [c[k] for c in cases], kind) for n, cases in enumerate(found)]
    total = sum(said(1, "int"), F.col("_ev.points") + F.col("_ev.season"))
    token = lambda says: F.when(F.col("_ev.says") == says, F.col("_ev.says"))
    rows = rows.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), total)), "matched": _present(F.col("_ev.field"), token("seasonToken"), *said(2, "string"))})
    has = lambda *fields: F.arrays_overlap("matched", F.array(*map(F.lit, fields)))
    aside = has("date", "quarter", "episodeCount", "officialUrl", "studio")
    only = [F.when(has("name_cn") & ~has("name", "alias", "english") & ~aside, F.lit("chinese_title_only")), F.when(has("alias") & ~has("name", "name_cn", "english") & ~aside, F.lit("alias_only"))]
    return rows.withColumn("risks", _present(token("season_token_mismatch"), *said(3, "string"), *only)).drop("_ev", *(f"_{n}" for n in range(len(found))))


def _risk(*names: str) -> Column:
    return F.arrays_overlap("risks", F.array(*map(F.lit, names)))


def finalized(rows: DataFrame, item: str = "i.id") -> DataFrame:
    """Ranks, leads, penalties for close candidates, and confidence; ranks are those before the penalty."""
    w = Window.partitionBy(F.col(item)).orderBy(F.col("score").desc(), F.col("s.id"))
    ranked = rows.withColumns({"rank": F.row_number().over(w), "lead": F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(100))})  # together, so that pairs are shuffled once
    close = F.col("lead") < 12
    points = F.greatest(F.lit(0), F.col("score") - F.when(F.col("lead") < 5, 20).when(close, 10).otherwise(0))
    ranked = ranked.withColumn("risks", F.when(close, F.array_union("risks", F.array(F.lit("multiple_close_candidates")))).otherwise(F.col("risks"))).withColumn("final", points)
    low = ~S.yes(F.col("s.type") == 2) | _risk("year_mismatch", "season_token_mismatch", "format_conflict")
    capped, single = _risk("multiple_close_candidates", "chinese_title_only", "alias_only"), _risk("chinese_title_only", "alias_only")
    level = F.when(low, F.lit("low")).when(single & (F.col("final") >= 45), F.lit("medium")).when((F.col("final") >= HIGH) & ~capped, F.lit("high")).when(F.col("final") >= MEDIUM, F.lit("medium")).otherwise(F.lit("low"))
    return ranked.withColumn("confidence", level)


def accepted() -> Column:
    """Whether a best candidate (with score and lead before penalties) may be bound without review."""
    has = lambda *fields: F.arrays_overlap("matched", F.array(*map(F.lit, fields)))
    score, lead = F.col("score"), F.col("lead")
    strong, date, site = has("name", "name_cn", "english", "alias"), has("date"), has("officialUrl")
    made = has("seasonToken", "episodeCount", "studio")
    aside = date | site | made
    arc = site & made & (score >= 50)
    official = site & (date | made) & (score >= 55)
    good = ((strong & aside) | official) & ((lead >= 15) | official | arc) & (~_risk("year_mismatch", "date_conflict") | arc)
    good = good & (~_risk("season_token_mismatch") | official) & (~_risk("alias_only") | (aside & (score >= 80))) & ~_risk("format_conflict")
    return good & (official | (arc & (strong | date)) | (site & date & (score >= 60)) | (score >= 74) | ((score >= 66) & date & (lead >= 25)))


def _blocked(rows: DataFrame, side: str, entries: Column, facts: Callable[[Column, Column], Column], season: Column, block: list[str], light: bool) -> DataFrame:
    """Rows by blocking key (_k), with their facts and all their keys, those of seasons first; rows of one id count as one."""
    row, mine, keys = F.col(side), f"_{side}", f"_{side}_keys"
    read = rows.withColumn("_t", _read_titles(entries))
    keyed = read.select(*([] if light else [side]), *block, facts(row, F.col("_t.forms")).alias(mine), F.concat(F.array_compact(F.array(F.concat(F.lit(_MONTH), season))), "_t.keys").alias(keys))
    firsts = [F.first(c).alias(c) for c in keyed.columns if c not in (*block, keys)]
    once = keyed.groupBy(F.col(f"{mine}.id").alias("_id"), *block).agg(*firsts, F.array_sort(F.array_distinct(F.flatten(F.collect_list(keys)))).alias(keys))
    return once.drop("_id").withColumn("_k", F.explode(keys))


def candidate_pairs(items: DataFrame, subjects: DataFrame, block: str | None = None, light: bool = False) -> DataFrame:
    """Pairs that share a title key, or an item's season with a subject's month; nothing else is compared.

    items: struct column i; subjects: struct column s; block: a column of both, if only rows of the same block may meet;
    light: of i only the id and of s the id and type are kept, which is what ranks and acceptance need.
    A pair comes from the first key that both have, so that pairs are neither shuffled nor looked through for repeated ones.
    """
    i, s, by = F.col("i"), F.col("s"), [] if block is None else [block]
    month = S.calendar_season(s["date"])
    named = lambda year, quarter: F.when(year.isNotNull() & quarter.isNotNull(), F.concat_ws(":", year.cast("string"), quarter))
    left = _blocked(items, "i", _item_entries(i), item_facts, named(i["primarySeason"]["year"], i["primarySeason"]["quarter"]), by, light)
    right = _blocked(subjects, "s", _subject_entries(s), subject_facts, named(month["year"], month["quarter"]), by, light)
    first = (F.col("_k") == F.get("_i_keys", F.lit(0))) | (F.col("_k") == F.get(F.array_intersect("_i_keys", "_s_keys"), F.lit(0)))
    both = left.join(right.hint("merge"), ["_k", *by]).where(first)  # Spark estimates rows by their files, which say nothing of what was made of them: it would broadcast all subjects
    kept = [F.struct("_i.id").alias("i"), F.struct("_s.id", "_s.type").alias("s")] if light else ["i", "s"]
    return both.select(*kept, F.startswith("_k", F.lit(_MONTH)).alias("from_month"), "_i", "_s")


def known_subject(title: Column, start: Column) -> Column:
    """Subject id of titles that are known by rule; null for others."""
    forms = X.titles_of(title)
    out = F.lit(None).cast("long")
    for subject, day, pattern in reversed(fixed.KNOWN_SUBJECTS):
        hit = X.any_matches(forms, (pattern,))
        out = F.when(hit if day is None else hit & S.yes(start == day), F.lit(subject).cast("long")).otherwise(out)
    return out
