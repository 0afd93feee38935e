"""Mixing sources to target weights by Pareto order sampling (operator 10), in built-in functions only.

Each source has a target in words.  A document's expected copies grow with the
binary digits of its size, to fill the target on average.  It goes into the mix
with as many whole copies as it is certain to have, and one more is drawn for
some: documents are ranked by their random odds divided by their inclusion
odds, and the first of that order are taken until the source's rest is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Copies of a document that a mix holds at most.
MOST_COPIES = 3
#: Rows of a source that one bin of the Pareto order holds on average, and the least number of bins.
BIN_ROWS, LEAST_BINS = 20_000, 64
#: A source table up to this many rows is broadcast; a longer one is joined with salted keys.
BROADCAST_ROWS = 20_000
SALTS = 32

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, none of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources: ``sizes`` has skey, source and source_size; adds weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  Targets share
    the sum of all sizes by weight but stop at MOST_COPIES times a source's
    size; what that leaves is shared again until none is above.  The share that
    this ends in is found at once: in order of cap over weight the first
    sources are capped, and the rest divide what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("skey"))
    whole = Window.partitionBy()
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(MOST_COPIES))
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    ranked = capped.withColumn("level", level)
    # The first source in this order whose cap its share does not reach sets the level for all after it.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), F.col("level").alias("level")))
    settled = ranked.withColumn("share", F.min(fits).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("share"), F.lit(float("inf"))) * F.col("weight"))
    return settled.select("skey", "source", "source_size", "weight", target.alias("target"))


def _with_small(rows: DataFrame, small: DataFrame, n_small: int, salt: Column) -> DataFrame:
    """Join ``small`` on skey: broadcast within the checked bound, else with the key's rows spread over salts."""
    if n_small <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), "skey")
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(copies, ["skey", "salt"]).drop("salt")


def expected_copies(classes: DataFrame) -> DataFrame:
    """Expected copies of a document: ``classes`` has skey, digits, words and target; gives skey, digits, copies.

    Copies are c * digits, MOST_COPIES at most, where c is such that a source's
    words times their copies sum up to its target.  With the longest first, the
    first classes are at the most, and the rest divide what that leaves; the
    share that this ends in is found at once, as in :func:`targets`.  A source
    has as many classes as a size has binary digits, 64 at most.
    """
    order = Window.partitionBy("skey").orderBy(F.col("digits").desc())
    whole = Window.partitionBy("skey")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("words") * F.col("digits")
    left = F.col("target") - F.lit(MOST_COPIES) * F.coalesce(F.sum("words").over(earlier), F.lit(0))
    parts = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    level = classes.withColumn("level", F.when(parts > 0, left / parts))
    fits = F.when(F.col("level") * F.col("digits") <= MOST_COPIES, F.struct((-F.col("digits")).alias("first"), "level"))
    settled = level.withColumn("share", F.min(fits).over(whole)["level"])
    copies = F.least(F.lit(float(MOST_COPIES)), F.coalesce(F.col("share"), F.lit(float("inf"))) * F.col("digits"))
    return settled.select("skey", "digits", F.greatest(copies, F.lit(0.0)).alias("expected"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, and copies.

    size is the text's words, none of a null; a null source is a source of its
    own.  The chance of a copy beyond the certain ones grows with the binary
    digits of size, see :func:`expected_copies`.  Random numbers come from md5
    of seed, id and the text's md5, so reruns agree and rows without an id draw
    their own; rows that agree in id and text are ranked one after the other.
    A document without words is never taken.  copies = taken / size lies in 0
    .. MOST_COPIES.  The words a source takes differ from its target by half
    its largest document at most.  Other columns are ignored; no rows give no
    rows.

    A source may hold a third of all rows: nothing ranks a whole source in one
    task.  Pareto ranks are cut into bins, words are summed by bin, and only
    the bin in which a source's rest ends is ranked row by row.
    """
    return _mix(docs, id_col, text_col, source_col, seed, False)


def digits_of(size: Column) -> Column:
    """Binary digits of a size; 0 of none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)).cast("int")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, carried: bool) -> DataFrame:
    """The rows of :func:`mix`, with the whole row as struct ``row`` if it is to be carried along; rows are not shuffled but for one bin."""
    row = ["row"] * carried
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * carried
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    draw = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("skey"), draw.alias("draw"), *whole,
    ).withColumn("digits", digits_of(F.col("size")))
    rows = scratch.stage(rows, "op10")
    classes = scratch.stage(rows.groupBy("skey", "source", "digits").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "op10-classes")
    sums = scratch.stage(classes.groupBy("skey", "source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), "op10-sources")
    n_sources, most = sums.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    bins = max(LEAST_BINS, -(-most // BIN_ROWS))
    goal = targets(sums.select("skey", "source", "source_size")).select("skey", "source_size", "target")
    expected = expected_copies(classes.select("skey", "digits", "words").join(goal.select("skey", "target"), "skey"))
    # Certain copies are the whole part of the expected ones; the rest of them is the chance of one more.
    chances = expected.select("skey", "digits", F.floor("expected").alias("certain"), (F.col("expected") - F.floor("expected")).alias("chance"))
    sure = classes.join(chances, ["skey", "digits"]).groupBy("skey").agg(F.sum(F.col("words") * F.col("certain")).alias("sure"))
    by_class = F.map_from_entries(F.collect_list(F.struct("digits", F.struct("certain", "chance")))).alias("classes")
    goal = goal.join(sure, "skey").join(chances.groupBy("skey").agg(by_class), "skey")
    goal = scratch.stage(goal.select("skey", "source_size", "target", (F.col("target") - F.col("sure")).alias("rest"), "classes"), "op10-targets")

    placed = _with_small(rows.select("doc_id", "size", "skey", "digits", "draw", *row), goal, n_sources, F.hash("doc_id", "draw"))
    placed = placed.withColumn("own", F.col("classes")[F.col("digits")]).drop("classes")
    placed = placed.withColumns({"certain": F.col("own.certain"), "chance": F.col("own.chance")}).drop("own")
    random_odds = (F.col("draw") + F.lit(0.5)) / (F.lit(float(1 << 48)) - (F.col("draw") + F.lit(0.5)))
    odds = F.col("chance") / (F.lit(1.0) - F.col("chance"))
    rank = F.when(F.col("chance") > 0, random_odds / F.when(F.col("chance") > 0, odds)).otherwise(F.lit(float("inf")))
    placed = placed.withColumn("rank", rank)
    # rank / (1 + rank) lies in 0 .. 1 and keeps the order.  At the rank where the chosen part ends it is about 1/2, so bins are even enough around it.
    spread = F.when(F.col("rank") == F.lit(float("inf")), F.lit(1.0)).otherwise(F.col("rank") / (F.lit(1.0) + F.col("rank")))
    placed = placed.withColumn("bin", F.least(F.floor(spread * F.lit(bins)), F.lit(bins - 1)).cast("int"))

    by_bin = placed.groupBy("skey", "bin").agg(F.sum("size").alias("w"), F.max("rest").alias("rest"))
    upto = Window.partitionBy("skey").orderBy("bin")
    cuts = by_bin.withColumn("base", F.sum("w").over(upto) - F.col("w"))
    cuts = cuts.where((F.col("base") < F.col("rest")) & (F.col("base") + F.col("w") >= F.col("rest")))
    cuts = cuts.groupBy("skey").agg(F.min(F.struct("bin", "base")).alias("cut"))
    cuts = goal.select("skey").join(cuts, "skey", "left").select("skey", F.col("cut.bin").alias("cut_bin"), F.col("cut.base").alias("base"))
    cut_rows = _with_small(placed, cuts, n_sources, F.hash("doc_id", "draw"))

    # A source without a cut has nothing left to fill (or nothing to fill it with).
    possible = F.col("chance") > 0
    before = F.coalesce((F.col("bin") < F.col("cut_bin")) & possible, F.lit(False))
    inside = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    # Rows that agree in all of these agree in id and text: which of them comes first makes no other mix.
    ordered = Window.partitionBy("skey").orderBy("rank", "doc_id", "size", "draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = cut_rows.where(inside).withColumn("upto", F.sum("size").over(ordered) - F.col("size") / 2)
    here = here.withColumn("extra", ((F.col("base") + F.col("upto") < F.col("rest")) & possible).cast("long")).drop("upto")
    other = cut_rows.where(~inside).withColumn("extra", before.cast("long"))
    copies = F.when(F.col("size") > 0, F.col("certain") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    result = here.unionByName(other).withColumn("copies", copies)
    return result.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *row)


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` as the mix holds it: each row, with all its columns, as often as it has copies."""
    taken = _mix(docs, id_col, text_col, source_col, seed, True).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
