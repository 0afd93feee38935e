"""Pages of a remote list as rows, by a client that the caller gives; nothing here opens a connection."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types_

from ..functions import titles
from ..operators import records as R

#: Rows of a page, and the last offset that is asked for.
PAGE_ROWS, LAST_OFFSET = 100, 1000
#: Forms of an item's titles that are searched for, and subjects found that are looked at.
MOST_TITLES, MOST_FOUND = 8, 12

#: What a client answers: the status of the response and its text.
Answer = tuple[int, str]


class RemoteError(RuntimeError):
    """A response that can't be used, with the public code of the error."""

    def __init__(self, code: str, message: str, status: int | None = None):
        super().__init__(message)
        self.code, self.status, self.retryable = code, status, code in ("RATE_LIMITED", "NETWORK_FAILED")


def body(answer: Answer) -> object:
    """A response's JSON."""
    status, text = answer
    if status == 429:
        raise RemoteError("RATE_LIMITED", "asked too often", status)
    if not 200 <= status < 300:
        raise RemoteError("API_ERROR", f"the source answered with status {status}", status)
    try:
        return json.loads(text)
    except ValueError as error:
        raise RemoteError("SOURCE_SCHEMA_CHANGED", "the answer is no JSON", status) from error


def fetched(client: Callable[..., Answer], *asked) -> object:
    """The JSON that a client gets for what is asked; what it raises itself is a failure of the network."""
    try:
        answer = client(*asked)
    except RemoteError:
        raise
    except Exception as error:
        raise RemoteError("NETWORK_FAILED", str(error)) from error
    return body(answer)


def pages(client: Callable[[int, int], Answer]) -> Iterable[list]:
    """Rows of a list, page by page: ``client(limit, offset)`` is asked until a page is short or LAST_OFFSET is reached."""
    for offset in range(0, LAST_OFFSET + 1, PAGE_ROWS):
        found = fetched(client, PAGE_ROWS, offset)
        rows = found.get("data") if isinstance(found, dict) else None
        if not isinstance(rows, list):
            raise RemoteError("SOURCE_SCHEMA_CHANGED", "a page has no list of rows")
        yield rows
        if len(rows) < PAGE_ROWS:
            return


def rows_of(spark: SparkSession, found: Iterable[dict], schema: types_.StructType) -> DataFrame:
    """JSON objects as rows of a schema; what they have besides is left out."""
    lines = spark.createDataFrame([(json.dumps(x, ensure_ascii=False),) for x in found], "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def listed(spark: SparkSession, client: Callable[[int, int], Answer], schema: types_.StructType, key: str = "id") -> DataFrame:
    """A whole list as rows: of those with one key the last, in the place of the first."""
    numbered = [x | {"_ordinal": n} for n, x in enumerate(r for page in pages(client) for r in page)]
    rows = rows_of(spark, numbered, types_.StructType([*schema.fields, types_.StructField("_ordinal", types_.LongType())]))
    return R.last_by_key(rows, [key], "_ordinal").orderBy("place").select(*schema.fieldNames())


def searched(spark: SparkSession, client: Callable[[str], Answer], entries: Iterable[tuple[str, str]], schema: types_.StructType, most_titles: int = MOST_TITLES, most: int = MOST_FOUND, key: str = "id") -> tuple[DataFrame, list[tuple]]:
    """What a source finds by the forms of a row's titles, (field, raw): the first ``most`` by key, in the order seen, and the searches that failed.

    Both limits are the source's, which answers few requests; candidates of a
    whole table come from ``match.candidate_pairs``, which has none.
    """
    seen: dict[object, dict] = {}
    failed = []
    for title in titles.search_titles(list(entries), most_titles):
        try:
            found = fetched(client, title)
        except RemoteError as error:
            failed.append((title, error.code, str(error)))
            continue
        for row in found.get("data") or [] if isinstance(found, dict) else []:
            seen.setdefault(row[key], row)
    return rows_of(spark, list(seen.values())[:most], schema), failed


def details(spark: SparkSession, client: Callable[[int], Answer], ids: Iterable[int], schema: types_.StructType) -> tuple[DataFrame, list[tuple]]:
    """Details of some rows by id, and (id, code, message) of those that could not be had."""
    got, failed = [], []
    for number in dict.fromkeys(ids):
        try:
            got.append(fetched(client, number))
        except RemoteError as error:
            failed.append((number, error.code, str(error)))
    return rows_of(spark, got, schema), failed
