"""Joins by the similarity of bit sets.

Bit sets are packed into 32-bit words held in bigint columns, so similarity is
a few ``bit_count`` calls in generated code.  ``query_pairs`` compares a stated
query set with all rows, in blocks: the queries are cut into blocks that fit a
task, each block meets each slice of the rows, and only the best ``k`` of a
block and slice leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = 32


def on_bit_words(vector: Column, width: int) -> list[Column]:
    """Words whose bits are the positive components of ``vector``."""
    words = []
    for begin in range(0, width, WORD):
        bits = F.lit(0).cast("bigint")
        for i in range(begin, min(width, begin + WORD)):
            bits = bits + F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - begin))).otherwise(F.lit(0)).cast("bigint")
        words.append(bits)
    return words


def with_words(df: DataFrame, key: str, vector: str, width: int, *others: str) -> tuple[DataFrame, list[str]]:
    names = [f"w{i}" for i in range(-(-width // WORD))]
    words = on_bit_words(F.col(vector), width)
    return df.select(key, *others, *[w.alias(n) for w, n in zip(words, names, strict=True)]), names


def _unpack(batch: pa.RecordBatch, words: list[str]) -> np.ndarray:
    stacked = np.stack([batch.column(w).to_numpy(zero_copy_only=False).astype(np.uint64) for w in words])
    return stacked.T.copy()


def top_similar(
    queries: DataFrame, rows: DataFrame, key: str, words: list[str], k: int, block: int = 1 << 18, same_set: bool = True
) -> DataFrame:
    """``(query, match, similarity, rank)``: the ``k`` most similar rows of
    each query, ties by the smaller id; a row is no match of itself when
    ``same_set``.

    The queries are read in blocks that travel to all slices of the rows, so
    nothing but the best ``k`` of each query in each slice is shuffled.  A block
    of ``block`` queries is a few megabytes; the rows are read once per block.
    """
    spark = rows.sparkSession
    id_type = rows.schema[key].dataType.simpleString()
    schema = f"query {id_type}, match {id_type}, similarity double"
    total = None
    for held in _blocks(queries.select(key, *words), block):
        sent = spark.sparkContext.broadcast(held)  # ``block`` rows

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, bits = sent.value
            count = np.bitwise_count(bits).sum(axis=1)
            # the best of the slice so far, a row per query
            top, match = np.full((len(ids), k), -1.0), np.zeros((len(ids), k), dtype=np.int64)
            for batch in batches:
                there = batch.column(key).to_numpy(zero_copy_only=False)
                mine = _unpack(batch, words)
                other = np.bitwise_count(mine).sum(axis=1)
                for begin in range(0, len(ids), 64):
                    part = slice(begin, begin + 64)
                    both = np.zeros((len(ids[part]), len(there)), dtype=np.int32)
                    for w in range(mine.shape[1]):
                        both += np.bitwise_count(bits[part, w, None] & mine[None, :, w]).astype(np.int32)
                    either = count[part, None] + other[None, :] - both
                    s = np.where(either > 0, both / np.maximum(either, 1), 0.0)
                    if same_set:
                        s[ids[part, None] == there[None, :]] = -1.0
                    order = np.lexsort((np.broadcast_to(there, s.shape), -s), axis=1)[:, :k]
                    v = np.concatenate([top[part], np.take_along_axis(s, order, axis=1)], axis=1)
                    m = np.concatenate([match[part], there[order]], axis=1)
                    order = np.lexsort((m, -v), axis=1)[:, :k]
                    top[part], match[part] = np.take_along_axis(v, order, axis=1), np.take_along_axis(m, order, axis=1)
            for begin in range(0, len(ids), 10_000):
                part = slice(begin, begin + 10_000)
                keep = top[part].ravel() >= 0
                columns = np.repeat(ids[part], k)[keep], match[part].ravel()[keep], top[part].ravel()[keep]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "match", "similarity"])

        part = rows.select(key, *words).mapInArrow(best, schema)
        total = part if total is None else total.unionByName(part)
    if total is None:
        total = spark.createDataFrame([], schema)
    order = W.partitionBy("query").orderBy(F.desc("similarity"), F.asc("match"))
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stated query set, one block at a time on the driver."""
    held: list = []
    for row in queries.toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            yield _as_arrays(held)
            held = []
    if held:
        yield _as_arrays(held)


def _as_arrays(held: list) -> tuple[np.ndarray, np.ndarray]:
    a = np.array(held, dtype=np.int64)
    return a[:, 0], a[:, 1:].astype(np.uint64)


def knn_predict(matches: DataFrame, targets: DataFrame, key: str, y: str) -> DataFrame:
    """``(query, y_true, y_pred)``: mean of the matches' targets weighted by
    similarity + 1e-6."""
    t = targets.select(F.col(key).alias("match"), F.col(y).cast("double").alias("__y"))
    own = targets.select(F.col(key).alias("query"), F.col(y).cast("double").alias("y_true"))
    w = F.col("similarity") + F.lit(1e-6)
    return (
        matches.join(t, "match").groupBy("query").agg((F.sum(w * F.col("__y")) / F.sum(w)).alias("y_pred")).join(own, "query")
    ).select("query", "y_true", "y_pred")


def stratum(similarity: Column) -> Column:
    """Published strata of the greatest similarity to train."""
    return F.when(similarity < 0.4, "<0.4").when(similarity <= 0.7, "0.4-0.7").otherwise(">0.7")
