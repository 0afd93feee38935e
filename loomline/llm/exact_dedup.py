"""Exact dedup by content sort (operator 1).

Sampled splitters range-partition the normalised texts, Spark's external sort
places equal texts next to each other, and each row is compared in full with
its neighbour.  The splitters are on (first characters, hash, id), so that a
text that a third of all rows share is spread over as many partitions as its
rows need; groups that cross a border are joined by comparing the texts at the
borders, two for each partition, where their hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .workers import small_batches, tidy

#: Characters of a text that a splitter holds; the hash after them tells longer equal beginnings apart.
SPLITTER_CHARS = 48

_RUNS = "kind int, doc_id long, text_sha256 string, pid int, grp long, head boolean, text string"


def normalised(text):
    """Null as empty; every run of ``[\\x20\\x09-\\x0D]`` becomes one space.

    A lone space is already what it would become, so only the other runs are
    matched: the result is the same and the scan much shorter.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _runs(carried: bool):
    """Number the runs of equal neighbours of one sorted partition; at its end, give the texts at its two borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        names = ["kind", "doc_id", "text_sha256", "pid", "grp", "head", "text"] + ["row"] * carried
        first, last, grp, kind, digests = None, None, -1, None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column("text")
            head = pa.concat_arrays([pa.array([last is None or texts[0].as_py() != last]), pc.not_equal(texts[1:], texts[:-1])])
            ids = pc.add(pc.cumulative_sum(head.cast(pa.int64())), grp)
            digest = batch.column("text_sha256")
            first = texts[0].as_py() if first is None else first
            grp, last, digests = ids[n - 1].as_py(), texts[n - 1].as_py(), [*digests[:1], digest[0].as_py(), digest[n - 1].as_py()]
            rows = [batch.column("row")] if carried else []
            kind = rows[0].type if carried else None
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column("doc_id"), batch.column("text_sha256"), pa.array([pid] * n, pa.int32()), ids, head, pa.nulls(n, pa.string()), *rows], names=names)
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([1, 2], pa.int32()), pa.nulls(2, pa.int64()), pa.array([digests[0], digests[-1]], pa.string()), pa.array([pid, pid], pa.int32()), pa.array([0, grp], pa.int64()), pa.nulls(2, pa.bool_()), pa.array([first, last], pa.string())]
                + ([pa.nulls(2, kind)] if carried else []),
                names=names,
            )

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after normalisation, a null text as an empty one.  Of
    equal texts the row with the smallest id is kept; a null id comes after
    every other, and of rows that agree in id and text exactly one is kept.
    keep_id is null only if a group has no id at all.  Rows that agree in text
    and id, such as those of one text without an id, lie in one range: no
    splitter tells them apart.  Other columns of ``docs`` are not looked at,
    whatever their names.  No rows give no rows.
    """
    return _groups(docs, id_col, text_col, False)


def _groups(docs: DataFrame, id_col: str, text_col: str, carried: bool) -> DataFrame:
    """The rows of :func:`exact_groups`, with the whole row as struct ``row`` if it is to be carried along."""
    small_batches(docs.sparkSession)
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carried else []
    norm = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(row or [F.col(text_col).alias("raw")]), F.substring(norm, 1, SPLITTER_CHARS).alias("start"), F.xxhash64(norm).alias("hash"))
    raw = F.col("row")[text_col] if carried else F.col("raw")
    order = [F.col("start"), F.col("hash")]
    id_order = F.col("doc_id").asc_nulls_last()
    dealt = keyed.repartitionByRange(*order, id_order).withColumn("text", normalised(raw))
    sorted_rows = dealt.sortWithinPartitions(*order, F.col("text"), id_order).select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), *["row"] * carried)
    schema = T.StructType([*T.StructType.fromDDL(_RUNS).fields, *([T.StructField("row", sorted_rows.schema["row"].dataType)] if carried else [])])
    runs = scratch.stage(sorted_rows.mapInArrow(tidy(_runs(carried)), schema), "op1")

    # The chain of borders: where a partition begins with the text that the one before ended with, the group goes on.
    # One task sees the hashes of two texts for each partition; the texts themselves are compared in a join.
    along = Window.orderBy("pid", "kind")
    border = runs.where("kind > 0").select("pid", "kind", "grp", F.col("text_sha256").alias("digest"))
    border = border.withColumns({"back": F.lag("pid").over(along), "alike": F.col("digest") == F.lag("digest").over(along)})
    texts = runs.where("kind > 0").select("pid", "kind", "text")
    ends, begins = (texts.where(F.col("kind") == k).select(F.col("pid").alias(name), F.col("text").alias(f"text_{name}")) for k, name in ((2, "back"), (1, "pid")))
    alike = border.where("kind = 1 and alike").select("pid", "back").join(ends, "back").join(begins, "pid")
    goes_on = alike.where("text_back = text_pid").select("pid", F.lit(1).alias("kind"), F.lit(True).alias("goes_on"))
    fresh = F.when(F.col("kind") == 2, F.col("grp") > 0).otherwise(F.col("goes_on").isNull())
    chain = border.join(goes_on, ["pid", "kind"], "left").withColumn("chain", F.sum(fresh.cast("int")).over(along))
    roots = chain.groupBy("chain").agg(F.min(F.struct("pid", "grp")).alias("root"))
    moved = chain.join(roots, "chain").select("pid", "grp", F.col("root.pid").alias("rpid"), F.col("root.grp").alias("rgrp")).distinct()

    rows = runs.where("kind = 0").select("doc_id", "text_sha256", "pid", "grp", "head", *["row"] * carried)
    # Groups are summed up within their partition first: no key has more rows than a partition, whatever is common.
    local = scratch.stage(rows.groupBy("pid", "grp").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "op1-groups")
    # Two border groups at most for each partition, whatever the input: small enough to broadcast.
    across = local.join(F.broadcast(moved), ["pid", "grp"])
    sums = across.groupBy("rpid", "rgrp").agg(F.min("keep_id").alias("whole_id"), F.sum("group_size").alias("whole_size"))
    whole = across.join(sums, ["rpid", "rgrp"]).select("pid", "grp", "whole_id", "whole_size", ((F.col("rpid") == F.col("pid")) & (F.col("rgrp") == F.col("grp"))).alias("begins"))
    groups = local.join(F.broadcast(whole), ["pid", "grp"], "left").select(
        "pid", "grp", F.when(F.col("whole_size").isNull(), F.col("keep_id")).otherwise(F.col("whole_id")).alias("keep_id"),
        F.coalesce("whole_size", "group_size").alias("group_size"), F.coalesce("begins", F.lit(True)).alias("begins"),
    )
    return rows.join(groups, ["pid", "grp"]).select("doc_id", "keep_id", "group_size", (F.col("head") & F.col("begins")).alias("kept"), "text_sha256", *["row"] * carried)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns: one for each text, whatever ids they have."""
    return _groups(docs, id_col, text_col, True).where("kept").select("row.*")
