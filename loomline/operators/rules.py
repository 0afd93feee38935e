"""What belongs in the library: one predicate from many small ones, over the columns of an item."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.seasons import yes


def _texts(*columns: Column | str) -> Column:
    return F.filter(F.concat(*(c if isinstance(c, Column) else F.array(c) for c in columns)), lambda t: t.isNotNull())


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def text_values() -> Column:
    """All texts that rules look at: titles, aliases, address and reason."""
    return _texts(F.array("title.original", "title.japanese", "title.chinese", "title.english"), _listed("title.aliases"), F.array("officialUrl", "exclusionReason"))


def subject_id() -> Column:
    return F.coalesce("bangumi.subjectId", "externalIds.bangumiSubjectId")


def from_source(*names: str) -> Column:
    """Whether the item has a source of one of the names."""
    return yes(F.exists("sources", lambda s: yes(s["name"].isin(*names))))


def kana(text: Column) -> Column:
    return X.matches(text, fixed.KANA)


def enough_known() -> Column:
    """A Chinese title, or enough ratings instead."""
    return yes(F.length(X.trim(F.col("title.chinese"))) > 0) | yes(F.col("bangumi.ratingCount") >= fixed.ENOUGH_RATINGS)


def japanese_site() -> Column:
    site = X.content_text(F.col("officialUrl"))
    return X.matches(site, f"{fixed.JAPANESE_DOMAIN}|{fixed.JAPANESE_BROADCASTERS}")


def admitted() -> Column:
    """Known from another source than the subject database alone, or plainly Japanese."""
    alone = yes(F.size("sources") > 0) & yes(F.forall("sources", lambda s: yes(s["name"] == "Bangumi")))
    staff = _texts(_listed("staff.studio"), _listed("staff.productionCommittee"), F.array("staff.originalWorkType"))
    elsewhere = yes(F.exists("schedule", lambda e: yes(e["source"].isNotNull() & (F.coalesce(e["source"]["name"], F.lit("")) != "Bangumi"))))
    return ~alone | kana(F.col("title.original")) | kana(F.col("title.japanese")) | japanese_site() | yes(F.exists(staff, kana)) | elsewhere


def japanese_production() -> Column:
    """A Japanese title together with a Japanese address or studio."""
    names = X.content_texts(_texts(_listed("staff.studio"), _listed("staff.productionCommittee")))
    return (kana(F.col("title.original")) | kana(F.col("title.japanese"))) & (japanese_site() | X.any_matches(names, (fixed.JAPANESE_STUDIOS,)))


def listed_subject(subject: Column) -> Column:
    """Whether a subject is on one of the lists of what stays out."""
    return yes(subject.isin(*fixed.FOREIGN_SUBJECTS, *fixed.NON_TV_SUBJECTS, *fixed.REVIEWED_SUBJECTS))


def adult(values: Column) -> Column:
    joined = F.lower(X.nfkc(F.array_join(values, " ")))
    return X.matches(joined, f"{fixed.ADULT}|{fixed.ADULT_TITLES}")


def foreign_brand(keys: Column) -> Column:
    return X.any_matches(keys, fixed.FOREIGN_BRANDS)


def foreign_title(keys: Column) -> Column:
    return X.any_matches(keys, fixed.FOREIGN_TITLES)


def foreign_tags(keys: Column) -> Column:
    """Tags of another origin, unless something shows a Japanese production."""
    return X.any_matches(keys, fixed.FOREIGN_TAGS) & ~X.any_matches(keys, (fixed.JAPANESE_TAGS, fixed.KANA))


def korean(title: Column) -> Column:
    key = X.content_text(title)
    return X.matches(key, fixed.HANGUL) & ~X.matches(key, fixed.KANA)


def movie(keys: Column) -> Column:
    return X.matches(F.array_join(keys, " "), fixed.MOVIES)


def special(keys: Column) -> Column:
    return X.matches(F.array_join(keys, " "), "|".join((fixed.SPECIALS, fixed.NON_TV_TITLES, fixed.WEB_TITLES, fixed.RECAPS)))


def late_season(keys: Column) -> Column:
    """A season number beyond the highest that is kept."""
    return yes(F.exists(X.season_numbers(F.array_join(keys, " ")), lambda n: yes(n > fixed.HIGHEST_SEASON)))


def eligible() -> Column:
    """Whether an item belongs in the library; cheap tests come first."""
    keys = X.content_texts(text_values())
    parts = [
        yes(F.col("format") == "tv"), enough_known(), F.coalesce("isJapaneseAnime", F.lit(True)), ~yes(F.col("inclusionStatus") == "excluded"), ~listed_subject(subject_id()),
        admitted(), ~adult(text_values()), ~foreign_brand(keys), ~foreign_title(keys) | japanese_production(), ~korean(F.col("title.original")), ~movie(keys), ~special(keys), ~late_season(keys),
    ]
    return reduce(and_, parts)
