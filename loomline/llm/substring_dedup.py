"""Removal of repeated substrings by suffix sorting of shards (operator 7).

Every byte that a LENGTH-byte string covers is removed if that string starts
anywhere else in the corpus, too.

Windows of LENGTH bytes are dealt to shards so that equal ones meet: a window
belongs to the anchor that it holds, the leftmost of its GRAM-byte strings with
the least hash, which depends on its bytes alone.  Neighbouring windows mostly
share their anchor and form a segment.  Segments that occur twice as a whole
are found by counting.  Of the others, those whose anchor occurs in another
segment go, one for each content, to the shard of their anchor, where external
induced sorting (see :mod:`.induced`) places equal windows next to each other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced, scratch
from .workers import small_batches, tidy

LENGTH = 200
GRAM = 32
#: Bytes of text that windows are formed of at a time.
PIECE = 1 << 18
#: Bytes of segments in a shard, about, and in the shards that one task sorts one after the other.
SHARD_BYTES, TASK_BYTES = 2_000_000, 128_000_000
#: Tasks that shards are dealt to at least, if there are as many shards.
LEAST_TASKS = 4_096
#: An anchor with more segments than this is not sorted in one shard; its windows are counted one by one instead.
ANCHOR_SEGMENTS = 20_000
#: Rows of a common anchor that one part of a salted join holds, about.
SALT_ROWS = 2_000
#: Bits of the table that tells which documents a step can leave where they are: 2**FILTER_BITS, 64 to a row.
FILTER_BITS = 26

if induced.CAP != LENGTH:
    raise ValueError("the suffix sorter counts common prefixes up to another length")

_SPAN = GRAM.bit_length() - 1
_WIDTH = LENGTH - GRAM + 1
_PLACE = np.uint64((1 << 24) - 1)


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTE = _byte_values()
_FACTORS = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 3)) & ((1 << 64) - 1)) for i in range(_SPAN)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, made of halves, quarters, and so on."""
    h = _BYTE[data]
    for i, factor in enumerate(_FACTORS):
        half = 1 << i
        upper = h[:-half] * factor
        upper += h[half:]
        upper ^= upper >> np.uint64(29)
        h = upper
    return h


def segments(data: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of the segments of texts at ``bounds`` in ``data``.

    A segment's windows start at consecutive bytes, lie in one text and share an anchor.
    """
    if len(data) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= _WIDTH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = _WIDTH - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in bounds if b - a >= LENGTH] or [np.empty(0, np.int64)])
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    anchor = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return h[anchor[first]], starts[first], np.diff(np.append(first, len(starts)))


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Texts joined to arrays of about PIECE bytes; a longer one is cut, with LENGTH - 1 bytes of overlap.

    With each array, (row, offset in its text, place in the array) of what it holds.
    """
    held: list[bytes] = []
    where: list[tuple[int, int, int]] = []
    n = 0
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[offset : offset + PIECE + LENGTH - 1]
            where.append((row, offset, n))
            held.append(part)
            n += len(part)
            if n >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), where
                held, where, n = [], [], 0
    if n:
        yield np.frombuffer(b"".join(held), np.uint8), where


def keys_of(ids: list[int | None], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's id and text, as two arrays: what a row's pieces are joined by again.

    Rows that agree in id and text share a key, and lose the same bytes.
    """
    raw = b"".join(xxhash.xxh3_128_digest(b"%d:" % i + t if i is not None else b":" + t) for i, t in zip(ids, texts, strict=True))
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Columns of a row's key.
_KEY = ["key_a", "key_b"]
_KEYS = "key_a long, key_b long"
_SEGMENTS = f"{_KEYS}, anchor long, content long, start int, windows int"


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        texts = [(t.as_py() or "").encode() for t in batch.column("text")]
        key_a, key_b = keys_of(batch.column("doc_id").to_pylist(), texts)
        for data, where in _pieces(texts):
            ends = [w[2] for w in where[1:]] + [len(data)]
            anchors, starts, windows = segments(data, [(w[2], e) for w, e in zip(where, ends, strict=True)])
            if not len(starts):
                continue
            part = np.searchsorted(np.array([w[2] for w in where]), starts, side="right") - 1
            row, offset, place = np.array(where).T
            raw = memoryview(data)
            content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(starts.tolist(), (windows + LENGTH - 1).tolist(), strict=True)), np.uint64, len(starts))
            rows = row[part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key_a[rows]), pa.array(key_b[rows]), pa.array(anchors.view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array((starts - place[part] + offset[part]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                ],
                names=[*_KEY, "anchor", "content", "start", "windows"],
            )


def filter_table(rows: DataFrame) -> np.ndarray:
    """Bits set at the keys of ``rows``: a table of a fixed size, whatever their number."""
    bit = F.pmod("key_a", F.lit(1 << FILTER_BITS))
    words = rows.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key_a, {1 << FILTER_BITS}) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table


def _passing(table, wanted: bool):
    """Rows whose key the table has (or has not), with that key; a row that it has not is surely not among those it was made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            key_a, key_b = keys_of(batch.column("doc_id").to_pylist(), [(t.as_py() or "").encode() for t in batch.column("text")])
            at = key_a & ((1 << FILTER_BITS) - 1)
            inside = ((bits[at >> 6] >> (at & 63)) & 1).astype(bool)
            mask = pa.array(inside == wanted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(mask), pa.array(key_a).filter(mask), pa.array(key_b).filter(mask), batch.column("text").filter(mask)], names=["doc_id", *_KEY, "text"])

    return run


_KEYED = f"doc_id long, {_KEYS}, text string"


def _joined(rows: DataFrame, table, by_doc: DataFrame, how: str = "inner") -> DataFrame:
    """Rows that the filter passes, joined with a table by key; the texts that it holds back are not shuffled."""
    return rows.mapInArrow(tidy(_passing(table, True)), _KEYED).join(by_doc, _KEY, how)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments asked for, from their texts."""
    for batch in _sliced(batches):
        rows = []
        for key_a, key_b, text, asked in zip(*(batch.column(c) for c in (*_KEY, "text", "asked")), strict=True):
            data = (text.as_py() or "").encode()
            rows += [(key_a.as_py(), key_b.as_py(), s["anchor"], s["start"], s["members"], s["kinds"], data[s["start"] : s["start"] + s["windows"] + LENGTH - 1]) for s in asked.as_py()]
        for at in range(0, len(rows), 20_000):
            columns = zip(*rows[at : at + 20_000], strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_KEY, "anchor", "start", "members", "kinds", "data"])


_SPANS = f"{_KEYS}, first int, last int"


def _spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows in the segments of each shard, whose rows follow each other; only of segments that have no equal."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("shard", *_KEY, "start", "members", "data")), strict=True)

    for _, group in itertools.groupby(rows(), lambda r: r[0]):
        lines = list(group)
        # Byte b is symbol b + 2, 1 ends a segment, and 0 the text.
        text = np.empty(sum(len(r[5]) for r in lines) + len(lines) + 1, np.uint16)
        at, places = 0, []
        for r in lines:
            n = len(r[5])
            text[at : at + n] = np.frombuffer(r[5], np.uint8)
            text[at : at + n] += 2
            text[at + n] = 1
            places.append(at)
            at += n + 1
        text[at] = 0
        repeated = induced.repeated_starts(text, 258)
        found = []
        for r, place in zip(lines, places, strict=True):
            if r[4] == 1:
                # Only whole windows count: what begins later runs over the segment's end.
                for a, b in zip(*_spans_of(repeated[place : place + len(r[5]) - LENGTH + 1]), strict=True):
                    found.append((r[1], r[2], r[3] + int(a), r[3] + int(b) + LENGTH - 1))
        if found:
            yield _spans_batch(found)


def _spans_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[*_KEY, "first", "last"])


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all windows of segments whose anchor has too many of them for a shard."""
    for batch in _sliced(batches):
        rows = []
        for key_a, key_b, start, members, data in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "start", "members", "data")), strict=True):
            rows += [(xxhash.xxh3_128_digest(data[i : i + LENGTH]), key_a, key_b, start + i, members) for i in range(len(data) - LENGTH + 1)]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["window", *_KEY, "start", "members"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that spans (first, end) cover; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            rows = []
            for text, asked in zip(batch.column("text"), spans, strict=True):
                data = (text.as_py() or "").encode()
                runs = merged([(s["first"], s["last"]) for s in asked or []])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if with_bytes else None))
            n, removed, count, digest, rest = zip(*rows, strict=True) if rows else ((),) * 5
            columns, names = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns, names = [*columns, pa.array(rest, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for.

    A null text counts as empty.  Matches lie within a text's UTF-8 bytes, in
    the same document or another; a removed run may end inside a character.
    All occurrences go, the first one too.  Rows that repeat a text lose all of
    it, if it has LENGTH bytes.  Rows are told apart by 128 bits of id and
    text: many may have no id, or the same.  Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    begun = scratch.mark()
    found = scratch.stage(rows.mapInArrow(tidy(_find_segments), _SEGMENTS), "op7-segments")
    # What is joined back on a key that may be common is staged first: a join of two plain shuffles is one that Spark can split.
    common = scratch.stage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "op7-common")
    # The rows of a common anchor are salted, as they meet again by content below.
    shared = found.join(common, "anchor").withColumn("salt", F.pmod(F.xxhash64(*_KEY, "start"), F.col("salts")).cast("int"))
    shared = scratch.stage(shared, "op7-shared")

    # By content: how often it occurs, and one occurrence; by anchor: how many contents it has.
    one = F.min(F.struct(*_KEY, "start", "windows")).alias("one")
    contents = scratch.stage(shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("members"), one, F.max("salts").alias("salts")), "op7-contents")
    kinds = scratch.stage(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "op7-kinds")
    twice = contents.where("members > 1").select("anchor", "content", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    whole = shared.join(twice, ["anchor", "content", "salt"])
    whole = whole.select(*_KEY, F.col("start").alias("first"), (F.col("start") + F.col("windows") + F.lit(LENGTH - 1)).alias("last"))

    asked = contents.join(kinds, "anchor").select(*(f"one.{c}" for c in _KEY), F.struct("anchor", F.col("one.start").alias("start"), F.col("one.windows").alias("windows"), "members", "kinds").alias("s"))
    asked = scratch.stage(asked.groupBy(*_KEY).agg(F.collect_set("s").alias("asked")), "op7-asked")
    table = spark.sparkContext.broadcast(filter_table(asked))
    cut = _joined(rows, table, asked).select(*_KEY, "text", "asked")
    cut = cut.mapInArrow(tidy(_cut_out), f"{_KEYS}, anchor long, start int, members long, kinds long, data binary").dropDuplicates([*_KEY, "anchor", "start"])
    cut = scratch.stage(cut, "op7-cut")
    table.destroy()

    total = cut.where(F.col("kinds") <= ANCHOR_SEGMENTS).agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    # A task sorts its shards one after the other, so that their number doesn't become that of a shuffle's partitions.
    tasks = min(shards, max(LEAST_TASKS, -(-total // TASK_BYTES)))
    dealt = cut.where(F.col("kinds") <= ANCHOR_SEGMENTS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = dealt.select("shard", *_KEY, "start", "members", "data").repartition(tasks, "shard").sortWithinPartitions("shard")
    sorted_spans = dealt.mapInArrow(tidy(_sort_shards), _SPANS)
    windows = cut.where(F.col("kinds") > ANCHOR_SEGMENTS).mapInArrow(tidy(_each_window), f"window binary, {_KEYS}, start int, members long")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    counted = windows.where("members = 1").join(often, "window").select(*_KEY, F.col("start").alias("first"), (F.col("start") + F.lit(LENGTH)).alias("last"))
    spans = whole.unionByName(sorted_spans).unionByName(counted)

    by_doc = scratch.stage(spans.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")), "op7-spans")
    scratch.release_unread(scratch.since(begun), by_doc)
    table = spark.sparkContext.broadcast(filter_table(by_doc))
    schema = _RESULT + ", kept binary" * with_bytes
    cleaned = _joined(rows, table, by_doc, "left").select("doc_id", "text", "spans").mapInArrow(tidy(_remove(with_bytes)), schema)
    clean = rows.mapInArrow(tidy(_passing(table, False)), _KEYED).select("doc_id", "text").mapInArrow(tidy(_remove(with_bytes)), schema)
    return cleaned.unionByName(clean)
