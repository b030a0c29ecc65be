"""Nearest rows, structural clusters for cold splits, training logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 if flat)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns(scaled)


def nearest(queries: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], block: int = 1 << 16, same_set: bool = True) -> DataFrame:
    """``(query, match, distance)``: the nearest row of each query, ties by
    the smaller id.  The stated queries go in blocks to all rows; one
    candidate per query leaves a slice."""
    spark = rows.sparkSession
    id_type = rows.schema[key].dataType.simpleString()
    schema = f"query {id_type}, match {id_type}, distance double"
    columns, total = list(columns), None
    for ids, x in _float_blocks(queries.select(key, *columns), block):
        sent = spark.sparkContext.broadcast((ids, x))  # ``block`` rows

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, x = sent.value
            least, match = np.full(len(ids), np.inf), np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                there = batch.column(key).to_numpy(zero_copy_only=False)
                y = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
                for begin in range(0, len(ids), 64):
                    q = slice(begin, begin + 64)
                    d = np.sqrt(((x[q, None, :] - y[None, :, :]) ** 2).sum(axis=2))
                    if same_set:
                        d[ids[q, None] == there[None, :]] = np.inf
                    order = np.lexsort((np.broadcast_to(there, d.shape), d), axis=1)[:, 0]
                    v, m = d[np.arange(len(order)), order], there[order]
                    nearer = (v < least[q]) | ((v == least[q]) & (m < match[q]))
                    least[q], match[q] = np.where(nearer, v, least[q]), np.where(nearer, m, match[q])
            keep = np.isfinite(least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(match[keep]), pa.array(least[keep])], names=["query", "match", "distance"])

        part = rows.select(key, *columns).mapInArrow(best, schema)
        total = part if total is None else total.unionByName(part)
    if total is None:
        return spark.createDataFrame([], schema)
    return total.groupBy("query").agg(F.min(F.struct("distance", "match")).alias("b")).select("query", "b.match", "b.distance")


def _float_blocks(queries: DataFrame, block: int):
    held: list = []
    for row in queries.toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            yield np.array([r[0] for r in held]), np.array([r[1:] for r in held], dtype=float)
            held = []
    if held:
        yield np.array([r[0] for r in held]), np.array([r[1:] for r in held], dtype=float)


def average_linkage(similarity: np.ndarray, n_clusters: int) -> np.ndarray:
    """Labels of agglomerative clustering by mean distance ``1 - similarity``;
    of equal distances the earliest pair merges; labels by first member.

    Each row keeps its nearest other, so a merge costs a few rows, not the
    whole matrix.
    """
    n = len(similarity)
    d = 1.0 - similarity.astype(float)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    at = d.argmin(axis=1) if n else np.zeros(0, dtype=int)
    least = d[np.arange(n), at]
    for _ in range(max(0, n - n_clusters)):
        a = int(least.argmin())
        b = int(at[a])
        a, b = min(a, b), max(a, b)
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[b], d[:, b] = np.inf, np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        label[label == b] = a
        least[b] = np.inf
        nearer = (merged < least) | ((merged == least) & (a < at))
        stale = np.isfinite(least) & ((at == a) | (at == b)) & ~nearer
        stale[a] = True
        nearer[[a, b]] = False
        least[nearer], at[nearer] = merged[nearer], a
        for i in np.flatnonzero(stale):
            at[i] = d[i].argmin()
            least[i] = d[i, at[i]]
    return np.unique(label, return_inverse=True)[1]


def _bit_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tanimoto similarity of two lists of bit sets, word by word."""
    both = np.zeros((len(a), len(b)), dtype=np.int32)
    for w in range(a.shape[1]):
        both += np.bitwise_count(a[:, w, None] & b[None, :, w])
    either = np.bitwise_count(a).sum(axis=1, dtype=np.int32)[:, None] + np.bitwise_count(b).sum(axis=1, dtype=np.int32)[None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def cluster_entities(entities: DataFrame, key: str, words: Sequence[str], n_clusters: int = 8, exemplars: int = 4000) -> DataFrame:
    """``(key, cluster)`` of bit sets by average linkage.

    Equal bit sets are one entity.  Up to ``exemplars`` different ones are all
    clustered, which is the method itself.  Of more, the ``exemplars`` with the
    smallest hashes are, and every other entity joins the cluster of the
    exemplar that is most like it (ties: the first by hash); average linkage
    compares all pairs, so this bound is what its one task holds.
    """
    words = list(words)
    spark = entities.sparkSession
    hashed = entities.select(*words).distinct().withColumn("__h", F.xxhash64(*words))
    chosen = hashed.orderBy("__h", *words).limit(exemplars).select(*words).toPandas()  # ``exemplars`` rows
    bits = np.ascontiguousarray(chosen[words].to_numpy(dtype=np.int64).view(np.uint64))
    order = np.lexsort(bits.T[::-1])
    labels = np.zeros(len(bits), dtype=np.int32)
    labels[order] = average_linkage(_bit_similarity(bits[order], bits[order]), n_clusters)
    sent = spark.sparkContext.broadcast((bits, labels))
    kind = entities.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, labels = sent.value
        for batch in batches:
            own = np.stack([batch.column(w).to_numpy(zero_copy_only=False) for w in words], axis=1).astype(np.int64).view(np.uint64)
            near = np.concatenate([_bit_similarity(own[i : i + 500], bits).argmax(axis=1) for i in range(0, len(own), 500)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(labels[near])], names=[key, "cluster"])

    return entities.select(key, *words).dropDuplicates([key]).mapInArrow(assign, f"`{key}` {kind}, cluster int")


def best_so_far(log: DataFrame, by: Sequence[str], at: str, value: str, patience: int) -> DataFrame:
    """Least value up to each step, steps since it was reached, and whether
    patience has run out; one unit's log is one training run."""
    upto = W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    best = log.withColumn("best", F.min(value).over(upto)).withColumn("best_at", F.min(F.struct(F.col(value), F.col(at))).over(upto)[at])
    return best.withColumn("waited", F.col(at) - F.col("best_at")).withColumn("stop", F.col("waited") >= patience)


__all__ = ["average_linkage", "best_so_far", "cluster_entities", "nearest", "standardised"]
