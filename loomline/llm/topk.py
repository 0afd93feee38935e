"""Exact top-k inner-product search (operator 8), term at a time.

Vectors are sparse integer rows: the terms are the dimensions.  For a block of
queries, each block of candidates is inverted into postings, each term's
postings are scattered with the queries' weights into dense score arrays, the
k best of each array are found by partition selection, and the lists that the
blocks give are merged.  Every candidate is scored for every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Queries that are broadcast and scored together, and the numbers they may hold in all: bounds of a block's size.
QUERY_BLOCK, BLOCK_NUMBERS = 16_384, 4_000_000
#: Scores held at a time, and candidates in a block.
SCORES, CANDIDATE_BLOCK = 4_000_000, 4_096

_FOUND = "query_id long, vec_id long, score long"


#: Scores whose bound stays below this are summed as 64-bit integers; the others as Python's, which have no bound.
EXACT = 1 << 62


def dense(column: pa.Array) -> np.ndarray:
    """A list column of whole doubles as a matrix of integers; shorter rows end in zeros, which is to say in absent terms.

    Integers are Python's own if one of them does not fit 62 bits.
    """
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) and np.abs(values).max() >= EXACT:
        out, values = np.zeros((len(column), width), object), np.array([int(x) for x in values], object)
    else:
        out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def largest(matrix: np.ndarray) -> int:
    """The largest absolute component, 0 of none."""
    return int(max(matrix.max(), -matrix.min())) if matrix.size else 0


def scored(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of each query (row) with each of n candidates, one term after the other, without overflow."""
    terms = min(queries.shape[1], len(postings))
    bound = sum(largest(queries[:, t]) * largest(postings[t][1]) for t in range(terms))
    kind = np.int64 if bound < EXACT else object
    scores = np.zeros((len(queries), n), kind)
    for term in range(terms):
        who, weights = postings[term]
        using = np.flatnonzero(queries[:, term])
        if not len(who) or not len(using):
            continue
        column, weights = queries[:, term].astype(kind), weights.astype(kind)
        if len(who) == n and len(using) == len(queries):  # a term that all have: the scatter is a plain sum
            scores += column[:, None] * weights
        else:
            scores[np.ix_(using, who)] += column[using, None] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of scores, places and scores of its k best; ids ascend, so of equal scores the first are kept."""
    n = scores.shape[1]
    mask = ids[None, :] == own[:, None]
    if mask.any():
        scores[mask] = scores.min() - 1  # fits, as scores of 64 bits stay below EXACT
    if n > k:
        cut = np.partition(scores, n - k, axis=1)[:, n - k]
    for row, line in enumerate(scores):
        at = np.flatnonzero(line >= cut[row]) if n > k else np.arange(n)
        at = at[np.argsort(-line[at], kind="stable")][: k + 1]
        at = at[~mask[row, at]][:k]
        yield at, _as_long(line[at])


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(1 << 63) <= x < 1 << 63 for x in scores):
        raise OverflowError("the score of one of a query's best vectors does not fit the 64 bits of its column")
    return scores.astype(np.int64)


def _search(block, k: int):
    """A mapInArrow function: the k best of each partition for the broadcast queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block.value
        n_q = len(query_ids)
        top_id, top_score = [np.empty((0,), np.int64)] * n_q, [np.empty((0,), np.int64)] * n_q
        step = max(1, SCORES // CANDIDATE_BLOCK)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                ids = part.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, matrix = ids[order], dense(pa.concat_arrays([part.column("terms")]))[order]
                postings = [(who, matrix[who, t]) for t in range(matrix.shape[1]) for who in [np.flatnonzero(matrix[:, t])]]
                for q in range(0, n_q, step):
                    for row, (found, score) in enumerate(best(scored(queries[q : q + step], postings, len(ids)), ids, query_ids[q : q + step], k), q):
                        both_id, both_score = np.concatenate([top_id[row], ids[found]]), np.concatenate([top_score[row], score])
                        keep = np.lexsort((both_id, -both_score))[:k]
                        top_id[row], top_score[row] = both_id[keep], both_score[keep]
        if n_q:
            sizes = [len(x) for x in top_id]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate(top_id)), pa.array(np.concatenate(top_score))], names=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and terms (array of whole doubles), floor(scale * x) of each component x as a double.

    Vectors that are null, have a null id, or hold a null, a NaN or an infinity
    (or a number that scaling makes one) take no part.  A whole double is exact,
    however large.
    """
    v = F.col(vector_col)
    scaled = lambda x: x.cast("double") * scale
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    small = lambda y: F.abs(y) < F.lit(float(1 << 53))  # noqa: E731  (beyond, a double is whole, and floor would give a long)
    terms = F.transform(v, lambda x: F.when(small(scaled(x)), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), terms.alias("terms"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller vec_id.

    Queries are the rows whose id ``every`` divides; candidates are all rows
    with another id.  Repeated ids: a query id asks once, with the smallest of
    its vectors; each row is a candidate of its own, repeated ones too.  See
    :func:`quantised` for vectors that take no part; an empty vector scores 0.
    Vectors of different lengths are compared as if the shorter ended in zeros.
    Scores are exact integers; one among a query's best that does not fit the
    64 bits of its column raises OverflowError, as no value would be right.

    The driver hands the queries on in blocks of a fixed size, each as one
    broadcast that ends with its block; candidates stay where they are and are
    never shuffled.  A block's results are written before the next begins, so
    neither the plan nor what executors hold grows with the blocks.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    queries = scratch.stage(queries, "op8-queries")
    width = max(1, queries.agg(F.max(F.size("terms"))).first()[0] or 1)
    size = max(1, min(QUERY_BLOCK, BLOCK_NUMBERS // width))
    ordered = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    after, found = None, []
    while True:
        rest = queries if after is None else queries.where(F.col("vec_id") > after)
        block = rest.orderBy("vec_id").limit(size).toArrow()
        ids = block["vec_id"].to_numpy()
        matrix = dense(pa.concat_arrays(block["terms"].chunks)) if block.num_rows else np.zeros((0, width), np.int64)
        sent = spark.sparkContext.broadcast((ids, matrix))
        best_rows = rows.mapInArrow(_search(sent, k), _FOUND).withColumn("rank", F.row_number().over(ordered).cast("int")).where(F.col("rank") <= k)
        found.append(scratch.stage(best_rows.select("query_id", "rank", "vec_id", "score"), "op8-found"))
        sent.destroy()
        if block.num_rows < size:
            return scratch.together(found)
        after = int(ids[-1])
