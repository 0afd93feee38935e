"""Text functions: Arrow UDFs where Unicode normalisation is needed, expressions elsewhere."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .seasons import yes

#: White space as ECMAScript has it.
SPACE = "\t\n\x0b\x0c\r                  　﻿"
_SPACES = re.compile(f"[{SPACE}]+")
#: Characters that UTF-8 read as Latin-1 is full of.
_MISREAD = re.compile("[ÃãÂÅæçèéåäðþ\u0080-\u009f]")


def trimmed(text: str) -> str:
    return text.strip(SPACE)


def single_spaced(text: str) -> str:
    return _SPACES.sub(" ", trimmed(text))


def repaired(text: str) -> str:
    """A text whose UTF-8 was read as Latin-1, read right, if that leaves fewer signs of damage."""

    def damage(t: str) -> int:
        return len(_MISREAD.findall(t)) + 3 * t.count("�")

    if not _MISREAD.search(text):
        return text
    again = bytes(ord(c) & 0xFF for c in text).decode("utf-8", "replace")
    return again if damage(again) < damage(text) else text


def folded(text: str) -> str:
    return trimmed(unicodedata.normalize("NFKC", text)).lower()


def content_key(text: str) -> str:
    return folded(repaired(text))


def search_key(text: str) -> str:
    return _SPACES.sub(" ", folded(text))


_MERGE = re.compile(f"[{re.escape(fixed.MERGE_PUNCTUATION)}{SPACE}]+")
_AUDIT = re.compile(f"[{re.escape(fixed.AUDIT_PUNCTUATION)}{SPACE}]+")


def merge_key(text: str) -> str:
    """A title as merging compares it."""
    return _MERGE.sub("", unicodedata.normalize("NFKC", text).lower())


def audit_key(text: str) -> str:
    return _AUDIT.sub("", content_key(text))


def identity_key(text: str) -> str:
    return _SPACES.sub("", folded(text))


def slug(text: str) -> str:
    return re.sub("[^a-z0-9一-鿿]+", "-", folded(text)).strip("-") or "unknown"


def string_udf(one):
    """An Arrow UDF of a function on strings; nulls stay null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore").astype(object)

    return run


def array_udf(one, drop_empty: bool = True):
    """The same on arrays: nulls in them are left out, and empty results if asked."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [k for k in (one(t) for t in a if t is not None) if k or not drop_empty])

    return run


repair = string_udf(repaired)
nfkc = string_udf(lambda t: unicodedata.normalize("NFKC", t))
content_text = string_udf(content_key)
search_text = string_udf(search_key)
merge_title = string_udf(merge_key)
audit_title = string_udf(audit_key)
identity_title = string_udf(identity_key)
slugified = string_udf(slug)
repair_all = array_udf(repaired)
content_texts = array_udf(content_key)
search_texts = array_udf(search_key, drop_empty=False)
merge_titles = array_udf(merge_key)


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def given(text: Column) -> Column:
    """Null instead of an empty text."""
    return F.when(F.length(text) > 0, text)


def filled(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return given(trim(text))


def ordered_union(*arrays: Column) -> Column:
    """Distinct values in order of their first occurrence."""
    return F.array_distinct(F.concat(*arrays))


def titles_of(title: Column, aliases: bool = True) -> Column:
    """A title's forms that are not blank, in the order original, japanese, chinese, english, aliases."""
    forms = F.array(title["original"], title["japanese"], title["chinese"], title["english"])
    forms = F.concat(forms, F.coalesce(title["aliases"], F.array().cast("array<string>"))) if aliases else forms
    return F.filter(forms, lambda t: yes(F.length(trim(t)) > 0))


def matches(text: Column, pattern: str) -> Column:
    return yes(text.rlike(f"(?iu){pattern}"))


def any_matches(texts: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text of the array matches a pattern."""
    return yes(F.exists(texts, lambda t: matches(t, "|".join(f"(?:{p})" for p in patterns))))


def numeral(text: Column) -> Column:
    """A number in digits or in Chinese numerals up to 99; null if it is neither."""
    places = F.array(*map(F.lit, fixed.NUMERALS))
    digit = lambda c: F.nullif(F.array_position(places, c).cast("int"), F.lit(0))
    tens, ones = F.substring_index(text, "十", 1), F.element_at(F.split(text, "十"), 2)
    ten = F.when(tens == "", F.lit(1)).otherwise(F.coalesce(digit(tens), F.lit(1)))
    chinese = F.when(F.contains(text, F.lit("十")), ten * 10 + F.coalesce(digit(ones), F.lit(0))).otherwise(digit(text))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(chinese)


def season_numbers(text: Column) -> Column:
    """All season numbers in a text."""
    found = [F.filter(F.regexp_extract_all(text, F.lit(f"(?iu){fixed.SEASON_NUMBER}"), F.lit(g)), lambda n: F.length(n) > 0) for g in (1, 2)]
    return F.transform(F.concat(*found), lambda n: numeral(F.translate(n, "０１２３４５６７８９", "0123456789")))


def genres(texts: Column) -> Column:
    """Genres whose words occur in a text of the array; Latin words only as whole ones."""
    found = []
    for genre, words in fixed.GENRES.items():
        latin = [re.escape(w) for w in words if re.fullmatch(r"[a-z0-9][a-z0-9+\-\s]*", w)]
        other = [re.escape(w) for w in words if not re.fullmatch(r"[a-z0-9][a-z0-9+\-\s]*", w)]
        pattern = "|".join([*([f"(?:^|[^a-z0-9])(?:{'|'.join(latin)})(?:[^a-z0-9]|$)"] if latin else []), *other])
        found.append(F.when(any_matches(texts, (pattern,)), F.lit(genre)))
    return F.filter(F.array(*found), lambda g: g.isNotNull())


# HTML

_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def named_entities(text: Column) -> Column:
    """The six references that pages of text use, in this order."""
    for name, char in _ENTITIES:
        text = F.regexp_replace(text, f"(?i){name}", char)
    return text


def markup_to_text(html: Column) -> Column:
    """Blocks and line breaks as line ends, other tags as spaces; references are left as they are."""
    for pattern, to in ((r"(?is)<script\b[^>]*>.*?</script>", "\n"), (r"(?is)<style\b[^>]*>.*?</style>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|tr|td|h[1-6]|section|article)>", "\n"), (r"<[^>]+>", " ")):
        html = F.regexp_replace(html, pattern, to)
    return html


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))
