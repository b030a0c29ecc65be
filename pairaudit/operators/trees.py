"""Tree ensembles on cells: forests and boosting over binned features.

A regression tree under squared loss sees of its rows only how many fall in
each cell of binned features and what their targets add up to.  So Spark
reduces the train rows of each block to cells first, whatever their number: the
grid has at most ``CELLS`` cells, because the bins per feature are chosen for
that.  One task per block then fits the ensemble on its cells with histograms,
and predicts the cells in which test rows fall; the rows look their cell up.
Blocks are a column, all blocks are fitted side by side, and the driver sees
no more than how many rows the tables have that rows are looked up in.

Features are categories.  Each is replaced by its smoothed mean target, test
rows by that of all train rows and train rows by that of the other folds, and
then cut at quantiles of the train rows.

Resampling is by cells: a bootstrap draws Poisson(n) rows of a cell of n, a
subsample Binomial(n, share), and each drawn row counts with the cell's mean.

Defined results: a block without train rows predicts null; a category that no
train row has takes the block's mean; null categories are a category; null
targets do not train; empty members give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairaudit.functions.buckets import with_bucket
from pairaudit.session import Materialized

#: Cells of the grid at most, and bins of a feature at most.
CELLS, MOST_BINS = 1 << 20, 64
#: Rows of a table that is sent to all tasks, at most.
SENT_ROWS = 1 << 15


@dataclass(frozen=True)
class Forest:
    """Bagged trees over the square root of the features at each node."""

    trees: int = 300
    depth: int = 30
    seed: int = 0

    def fit_predict(self, x: np.ndarray, n: np.ndarray, total: np.ndarray, test: np.ndarray, bins: int) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        mean, out = total / n, np.zeros(len(test))
        some = max(1, int(np.sqrt(x.shape[1])))
        for _ in range(self.trees):
            w = rng.poisson(n).astype(float)
            if not w.any():
                w = n.astype(float)
            out += _tree(x, w, w * mean, test, bins, self.depth, some, rng)[1]
        return out / self.trees


@dataclass(frozen=True)
class Boosted:
    """Gradient boosting under squared loss with ridge on the leaves."""

    rounds: int = 600
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    ridge: float = 1.0
    seed: int = 0

    def fit_predict(self, x: np.ndarray, n: np.ndarray, total: np.ndarray, test: np.ndarray, bins: int) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        mean = total / n
        at, out = np.full(len(x), total.sum() / n.sum()), np.full(len(test), total.sum() / n.sum())
        for _ in range(self.rounds):
            w = rng.binomial(n, self.subsample).astype(float)
            step, there = _tree(x, w, w * (mean - at), test, bins, self.depth, x.shape[1], rng, self.ridge)
            at += self.rate * step
            out += self.rate * there
        return out


def _tree(x: np.ndarray, w: np.ndarray, wy: np.ndarray, test: np.ndarray, bins: int, depth: int, some: int, rng: np.random.Generator, ridge: float = 0.0):  # noqa: ANN202
    """Leaf values of ``x`` and of ``test``; one level of nodes at a time."""
    n_features = x.shape[1]
    node, there = np.zeros(len(x), dtype=np.int64), np.zeros(len(test), dtype=np.int64)
    n_nodes = 1
    value = np.array([wy.sum() / (w.sum() + ridge)]) if w.sum() else np.zeros(1)
    done_x, done_t = np.zeros(len(x)), np.zeros(len(test))
    live_x, live_t = np.arange(len(x)), np.arange(len(test))
    for _ in range(depth):
        if not len(live_x):
            break
        xs, ws, wys = x[live_x], w[live_x], wy[live_x]
        best = np.full(n_nodes, 1e-12)
        feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes, dtype=np.int64)
        wanted = np.argsort(rng.random((n_nodes, n_features)), axis=1)[:, :some] if some < n_features else None
        for f in range(n_features):
            slot = node * bins + xs[:, f]
            sw = np.bincount(slot, ws, n_nodes * bins).reshape(n_nodes, bins).cumsum(axis=1)
            sy = np.bincount(slot, wys, n_nodes * bins).reshape(n_nodes, bins).cumsum(axis=1)
            tw, ty = sw[:, -1:], sy[:, -1:]
            rw, ry = tw - sw, ty - sy
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sy**2 / (sw + ridge) + ry**2 / (rw + ridge) - ty**2 / (tw + ridge)
            gain = np.where((sw > 0) & (rw > 1e-9), gain, 0.0)
            if wanted is not None:
                gain[~(wanted == f).any(axis=1)] = 0.0
            k = gain.argmax(axis=1)
            g = gain[np.arange(n_nodes), k]
            better = g > best + 1e-9 * np.abs(best)
            best[better], feature[better], cut[better] = g[better], f, k[better]
        # leaves keep their value; the others split in two
        split = feature >= 0
        new = np.cumsum(split) - 1
        keep_x, keep_t = split[node], split[there]
        done_x[live_x[~keep_x]], done_t[live_t[~keep_t]] = value[node[~keep_x]], value[there[~keep_t]]
        live_x, live_t = live_x[keep_x], live_t[keep_t]

        def down(rows: np.ndarray, at: np.ndarray, feature=feature, cut=cut, new=new) -> np.ndarray:
            right = rows[np.arange(len(rows)), feature[at]] > cut[at]
            return 2 * new[at] + right

        node, there = down(x[live_x], node[keep_x]), down(test[live_t], there[keep_t])
        n_nodes = 2 * int(split.sum())
        if not n_nodes:
            break
        sw, sy = np.bincount(node, w[live_x], n_nodes), np.bincount(node, wy[live_x], n_nodes)
        value = sy / np.maximum(sw + ridge, 1e-12)
    done_x[live_x], done_t[live_t] = value[node] if len(live_x) else 0.0, value[there] if len(live_t) else 0.0
    return done_x, done_t


def _looked_up(rows: DataFrame, found: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with what a written table says of them.

    Only a table of few rows is sent to all tasks.  Left to adaptive execution,
    tables are sent that are small as written and many times that in the
    driver's memory, several of them at once.
    """
    few = found.count() <= SENT_ROWS
    return rows.join(found.hint("broadcast" if few else "merge"), list(on), how)


def target_encoded(
    members: DataFrame, by: Sequence[str], keys: dict[str, str], folds: int = 5, shrink: float = 5.0, store: Materialized | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with smoothed mean targets, ``keys`` from column to
    new column.

    Train rows are encoded by the other folds alone, their overall mean
    included; test rows by all train rows.  A key not seen takes that mean.

    The encodings of a key, one per fold and one for test rows, are one row of
    a table that is written, so rows are joined once a key.
    """
    by, store = list(by), store or Materialized(members.sparkSession, "encoding")
    fold = (F.pmod(F.col("row_index") * F.lit(48271), F.lit(65537)) % F.lit(folds)).cast("int")
    known = members.filter("role = 'train' AND y IS NOT NULL").withColumn("__f", fold)
    parts = range(folds)

    def sums(p: str) -> list[Column]:
        own = [F.when(F.col("__f") == i, F.col("y")) for i in parts]
        return [c for i, y in enumerate(own) for c in (F.coalesce(F.sum(y), F.lit(0.0)).alias(f"{p}s{i}"), F.count(y).alias(f"{p}n{i}"))]

    def total(name: str, but: int | None = None) -> Column:
        return reduce(Column.__add__, [F.col(f"{name}{i}") for i in parts if i != but], F.lit(0))

    smoothed = lambda s, n, mu: (s + F.lit(shrink) * mu) / (n + F.lit(shrink))
    # means of the other folds, and of all
    prior = [(total("__os", i) / F.nullif(total("__on", i), F.lit(0))).alias(f"__mu{i}") for i in parts]
    overall = store.write(known.groupBy(*by).agg(*sums("__o")).select(*by, *prior, (total("__os") / total("__on")).alias("__mu")))
    train = known
    test = _looked_up(members.filter("role = 'test'"), overall.select(*by, "__mu"), by, "left")
    for key, name in keys.items():
        own = F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("__k")
        counted = known.groupBy(*by, own).agg(*sums("__"))
        left_out = F.array(*[smoothed(total("__s", i), total("__n", i), F.col(f"__mu{i}")) for i in parts]).alias("__v")
        of_key = store.write(_looked_up(counted, overall, by).select(*by, "__k", left_out, smoothed(total("__s"), total("__n"), F.col("__mu")).alias("__w")))
        train = _looked_up(train.withColumn("__k", own), of_key, [*by, "__k"]).withColumn(name, F.get("__v", F.col("__f"))).drop("__k", "__v", "__w")
        unseen = smoothed(F.lit(0.0), F.lit(0), F.col("__mu"))
        test = _looked_up(test.withColumn("__k", own), of_key, [*by, "__k"], "left").withColumn(name, F.coalesce("__w", unseen)).drop("__k", "__v", "__w")
    return train.drop("__f"), test.drop("__mu")


def fit_blocks(members: DataFrame, features: Sequence[str], model: Forest | Boosted, name: str, block: str = "block_id", cells: int = CELLS) -> DataFrame:
    """``(block, row_index, model, y_true, y_pred)``: every block with a model
    of its own, fitted on its train rows and applied to its test rows."""
    features = list(features)
    bins = int(min(MOST_BINS, max(2, cells ** (1 / len(features)))))
    encoded = [f"__e{i}" for i in range(len(features))]
    places = [f"__b{i}" for i in range(len(features))]
    kept = members.select(block, "row_index", "role", F.col("y").cast("double").alias("y"), *[F.col(f).alias(f"__c{i}") for i, f in enumerate(features)])
    store = Materialized(members.sparkSession, "trees")
    # each step is written, so that no plan holds the one before several times
    train, test = target_encoded(kept, [block], {f"__c{i}": e for i, e in enumerate(encoded)}, store=store)
    train = store.write(train.select(block, "row_index", "y", *encoded))
    quantiles = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = store.write(train.groupBy(block).agg(*[F.percentile_approx(e, quantiles, F.lit(10_000)).alias(f"__q{i}") for i, e in enumerate(encoded)]))

    def placed(rows: DataFrame) -> DataFrame:
        rows = _looked_up(rows, edges, [block], "left")
        for i, e in enumerate(encoded):
            rows = with_bucket(rows, F.col(e), F.coalesce(F.col(f"__q{i}"), F.array().cast("array<double>")), places[i], bins.bit_length())
        return rows.select(block, "row_index", "y", *places)

    test = store.write(placed(test))
    known = placed(train).groupBy(block, *places).agg(F.count("*").alias("__n"), F.sum("y").alias("__s"))
    known = known.select(*[F.col(c).alias(c) for c in known.columns])
    asked = test.select(*[F.col(c).alias(c) for c in (block, *places)]).distinct()
    schema = T.StructType([T.StructField(block, members.schema[block].dataType), *[T.StructField(p, T.IntegerType()) for p in places], T.StructField("y_pred", T.DoubleType())])

    def fit(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({c: [] for c in schema.names})
        out = b[[block, *places]].sort_values(places)
        if not len(a):
            return out.assign(y_pred=None)
        a = a.sort_values(places)
        x, n = a[places].to_numpy(np.int64), a["__n"].to_numpy(np.int64)
        return out.assign(y_pred=model.fit_predict(x, n, a["__s"].to_numpy(float), out[places].to_numpy(np.int64), bins))

    predicted = store.write(known.groupBy(block).cogroup(asked.groupBy(block)).applyInPandas(fit, schema))
    store.drop(train)
    return _looked_up(test, predicted, [block, *places], "left").select(block, "row_index", F.lit(name).alias("model"), F.col("y").alias("y_true"), "y_pred")
