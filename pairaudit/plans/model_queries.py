"""Queries on models, clusters, stored metrics and further checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.functions import sequences
from pairaudit.operators import models, resample, scoring, similarity, trees, verify
from pairaudit.plans.common import FINITE_SQL, FOLDS_SQL, PAIRS_SQL, PANEL_SQL, RECORDS_SQL, REPEAT_SQL, finite_panel, folds, members, pairs, panel, r6, records
from pairaudit.plans.curation_queries import _SIMILAR, _bits, _stated
from pairaudit.plans.scoring_queries import _score_sql
from pairaudit.session import Materialized
from pairaudit.sources.catalog import table

UNIT = ["split", "block_id", "model"]


def forest_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests on one side's features each: host, guest, conditions, source."""
    # written once: it is read for each side
    blocks, out = Materialized(spark, "members").write(members(spark, sf_dir)), None
    sides = {"host_only_RF": ["host"], "guest_only_RF": ["guest"], "cond_only_RF": ["solvent", "ph"], "source_only_RF": ["source"]}
    for name, features in sides.items():
        part = trees.fit_blocks(blocks, features, trees.Forest(), name)
        out = part if out is None else out.unionByName(part)
    return scoring.guarded_scores(out, ["block_id", "model"]).select("block_id", "model", "n", "r2", "status")


def boosted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = Materialized(spark, "members").write(members(spark, sf_dir))
    out = trees.fit_blocks(blocks, ["host", "guest", "solvent", "ph", "source", "family"], trees.Boosted(), "boosted")
    return scoring.guarded_scores(out, ["block_id", "model"]).select("block_id", "model", "n", "r2", "status")


def cluster_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one structural cluster out: eight clusters of the vectors by
    their positive components."""
    bits, words = _bits(spark, sf_dir)
    clusters = models.cluster_entities(bits, "vec_id", words)
    rows = bits.select("vec_id", "label").join(clusters, "vec_id")
    per = rows.groupBy("cluster").agg(F.count("*").alias("n_test"), F.countDistinct("label").alias("n_labels"))
    total = bits.count()
    return per.select("cluster", "n_test", (F.lit(total) - F.col("n_test")).alias("n_train"), "n_labels")


COLUMNS = ["s_acctbal", "s_nationkey"]


def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-nearest neighbour on standardised columns, stated queries."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    scaled = models.standardised(rows, COLUMNS)
    found = models.nearest(scaled.filter("id % 100 = 0"), scaled, "id", COLUMNS)
    return found.select("query", "match", r6("distance").alias("distance"))


def metric_recomputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the first copy against those of the second."""
    a = scoring.guarded_scores(panel(spark, sf_dir), UNIT).select(*UNIT, F.round("r2", 6).alias("r2"))
    b = scoring.guarded_scores(panel(spark, sf_dir, "predictions_repeat"), UNIT).select(*UNIT, F.round("r2", 6).alias("r2"))
    return verify.metric_faults(a, b, UNIT, "r2")


def membership_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.membership_faults(folds(spark, sf_dir), "fold")


def normal_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ranks of all residuals per model: too many to enumerate."""
    residuals = finite_panel(spark, sf_dir).select("model", (F.col("y_true") - F.col("y_pred")).alias("margin"))
    return resample.normal_wilcoxon(residuals, ["model"]).select("model", "n", F.round("w", 1).alias("w"), r6("z").alias("z"), r6("p_value").alias("p_value"))


def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, ninth decile and share above 0.4 of greatest similarities."""
    bits, words = _bits(spark, sf_dir)
    best = similarity.top_similar(_stated(bits), bits, "vec_id", words, 1)
    q = F.percentile("similarity", F.array(F.lit(0.5), F.lit(0.9)))
    return best.agg(F.count("*").alias("n"), q.alias("q"), F.avg((F.col("similarity") > 0.4).cast("int")).alias("above")).select(
        "n", r6(F.col("q")[0]).alias("median"), r6(F.col("q")[1]).alias("p90"), r6("above").alias("above")
    )


def name_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each structure in the order in which they first appear."""
    first = records(spark, sf_dir).filter("host_name IS NOT NULL AND host_smiles IS NOT NULL").groupBy("host_smiles", "host_name").agg(F.min("row_index").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "host_name"))), lambda x: x["host_name"])
    return first.groupBy("host_smiles").agg(F.count("*").alias("n_names"), F.array_join(ordered, " | ").alias("names"))


def top_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent hosts, ties by id."""
    return pairs(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(8)


def family_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family of a source's first record and its three most frequent ones."""
    kept = records(spark, sf_dir).filter("family IS NOT NULL AND source IS NOT NULL")
    counts = kept.groupBy("source", "family").agg(F.count("*").alias("n"), F.min(F.struct("row_index", "family")).alias("first"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "family"))), 1, 3)
    mix = F.array_join(F.transform(ranked, lambda x: F.concat(x["family"], F.lit(":"), (-x["m"]).cast("string"))), " ")
    return counts.groupBy("source").agg(F.min("first")["family"].alias("first_family"), mix.alias("mix"))


def target_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in single precision: how many distinct values that leaves."""
    p = pairs(spark, sf_dir)
    return p.groupBy("source").agg(F.countDistinct("y").alias("n_double"), F.countDistinct(F.col("y").cast("float")).alias("n_single"))


def random_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five 80/20 splits: share of test guests that train has as well."""
    from pairaudit.operators import splits

    key = F.col("guest") * 31 + F.col("host") * 17 + F.col("cond2")
    rows = splits.with_blocks(pairs(spark, sf_dir), 5)
    role = F.when((key * F.lit(48271) + F.col("block") * F.lit(7919)) % F.lit(65537) % F.lit(5) == 0, "test").otherwise("train")
    out = splits.leakage(rows.withColumn("role", role), ["block"], ["guest"])
    return out.select("block", "entity", "n_test", "n_seen", r6("share").alias("share"))


def ambiguous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures whose names agree on their labels, and those that do not."""
    r = records(spark, sf_dir).filter("host_smiles IS NOT NULL")
    named = r.select("host_smiles", F.coalesce(F.lower("host_name").contains("calix"), F.lit(False)).alias("calix"), F.coalesce(F.lower("host_name").contains("cd"), F.lit(False)).alias("cd"))
    out = sequences.ambiguous(named, "host_smiles", ["calix", "cd"])
    return out.groupBy("n_readings", "calix", "cd").agg(F.count("*").alias("n"))


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in their compatibility form without case, with their spellings."""
    names = table(spark, sf_dir, "clean_condition").filter("host_name IS NOT NULL").groupBy("host_name").agg(F.count("*").alias("n"))
    return names.groupBy(sequences.compatible_fold("host_name").alias("name")).agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_records"))


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early stopping over the daily mean order price of each priority."""
    orders = table(spark, sf_dir, "orders")
    log = orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("step")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"))
    out = models.best_so_far(log, ["o_orderpriority"], "step", "loss", 2)
    return out.select("o_orderpriority", "step", "loss", "best", "best_at", "waited", "stop")


QUERIES = {
    f.__name__: f
    for f in (
        forest_nulls, boosted_model, cluster_cold, nearest_neighbour, metric_recomputation, membership_faults, normal_wilcoxon,
        similarity_summary, name_multimap, top_frequencies, family_mix, target_text, random_halves, ambiguous_labels,
        folded_names, best_so_far,
    )
}

ORACLE = {
    # the tail of the normal distribution by Simpson's rule
    "normal_wilcoxon": "WITH " + FINITE_SQL + """, d AS MATERIALIZED (SELECT model, y_true - y_pred AS v FROM finite_panel),
      r AS (SELECT model, v, rank() OVER (PARTITION BY model ORDER BY abs(v)) + (count(*) OVER (PARTITION BY model, abs(v)) - 1) / 2.0 AS r,
              count(*) OVER (PARTITION BY model, abs(v)) AS c FROM d WHERE v <> 0),
      s AS (SELECT model, count(*) AS n, coalesce(sum(r) FILTER (WHERE v > 0), 0) AS p, sum(r) AS t, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r GROUP BY 1),
      z AS (SELECT model, n, least(p, t - p) AS w, (least(p, t - p) - n * (n + 1) / 4.0)
              / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)
      SELECT model, n, CAST(round(w, 1) AS DOUBLE) AS w, round(z, 6) AS z, round(greatest(0, 1 - sqrt(2 / pi()) * abs(z) / 3000 * (
        SELECT sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(i * abs(z) / 1000, 2) / 2)) FROM range(1001) q(i))), 6) AS p_value FROM z""",
    "nearest_neighbour": """WITH s AS (SELECT s_suppkey AS id, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS a,
        (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS b FROM supplier),
      d AS (SELECT q.id AS query, r.id AS match, sqrt((q.a - r.a) * (q.a - r.a) + (q.b - r.b) * (q.b - r.b)) AS distance
            FROM s q JOIN s r ON q.id <> r.id WHERE q.id % 100 = 0)
      SELECT query, match, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, match) AS k FROM d) WHERE k = 1""",
    "metric_recomputation": "WITH " + PANEL_SQL + ", " + REPEAT_SQL + ", a AS (" + _score_sql("panel", "split, block_id, model") + "), b AS ("
    + _score_sql("repeat_panel", "split, block_id, model") + """)
      SELECT * FROM (SELECT split, block_id, model, CASE WHEN a.n IS NULL THEN 'not_stored' WHEN b.n IS NULL THEN 'not_recomputed'
        WHEN (a.raw IS NULL) <> (b.raw IS NULL) THEN 'definedness' WHEN abs(round(a.raw, 6) - round(b.raw, 6)) > 1e-14 THEN 'value' END AS fault
      FROM a FULL JOIN b USING (split, block_id, model)) WHERE fault IS NOT NULL""",
    "membership_faults": "WITH " + FOLDS_SQL + """, r AS (SELECT fold, row_index, count(*) FILTER (WHERE role = 'train') AS r, count(*) FILTER (WHERE role = 'test') AS t FROM folds GROUP BY 1, 2),
      b AS (SELECT fold, count(*) FILTER (WHERE r > 0 AND t > 0) AS train_and_test, count(*) FILTER (WHERE r > 1 OR t > 1) AS repeated,
              CAST(max(r) = 0 AS BIGINT) AS no_train, CAST(max(t) = 0 AS BIGINT) AS no_test FROM r GROUP BY 1)
      SELECT fold, fault, n FROM (UNPIVOT b ON train_and_test, repeated, no_train, no_test INTO NAME fault VALUE n) WHERE n > 0""",
    "similarity_summary": "WITH " + _SIMILAR + """ SELECT count(*) AS n, round(quantile_cont(similarity, 0.5), 6) AS median, round(quantile_cont(similarity, 0.9), 6) AS p90,
      round(avg(CAST(similarity > 0.4 AS INTEGER)), 6) AS above FROM sim WHERE rank = 1""",
    "name_multimap": "WITH " + RECORDS_SQL + """, f AS (SELECT host_smiles, host_name, min(row_index) AS k FROM records WHERE host_name IS NOT NULL AND host_smiles IS NOT NULL GROUP BY 1, 2)
      SELECT host_smiles, count(*) AS n_names, string_agg(host_name, ' | ' ORDER BY k, host_name) AS names FROM f GROUP BY 1""",
    "top_frequencies": "WITH " + PAIRS_SQL + " SELECT host, count(*) AS n FROM pairs GROUP BY host ORDER BY n DESC, host LIMIT 8",
    "family_mix": "WITH " + RECORDS_SQL + """, k AS (SELECT * FROM records WHERE family IS NOT NULL AND source IS NOT NULL),
      c AS (SELECT source, family, count(*) AS n FROM k GROUP BY 1, 2),
      t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, family) AS r FROM c),
      f AS (SELECT source, arg_min(family, row_index) AS first_family FROM k GROUP BY 1)
      SELECT source, first_family, string_agg(family || ':' || n, ' ' ORDER BY r) AS mix FROM t JOIN f USING (source) WHERE r <= 3 GROUP BY 1, 2""",
    "target_text": "WITH " + PAIRS_SQL + " SELECT source, count(DISTINCT y) AS n_double, count(DISTINCT CAST(y AS FLOAT)) AS n_single FROM pairs GROUP BY source",
    "random_halves": "WITH " + PAIRS_SQL + """, b AS (SELECT CAST(block AS INTEGER) AS block, guest, ((guest * 31 + host * 17 + cond2) * 48271 + block * 7919) % 65537 % 5 = 0 AS test
        FROM pairs CROSS JOIN range(5) t(block)),
      s AS (SELECT block, guest, count(*) FILTER (WHERE test) AS t, bool_or(NOT test) AS seen FROM b GROUP BY 1, 2)
      SELECT block, 'guest' AS entity, CAST(sum(t) AS BIGINT) AS n_test, CAST(coalesce(sum(t) FILTER (WHERE seen), 0) AS BIGINT) AS n_seen,
        round(coalesce(sum(t) FILTER (WHERE seen), 0) / sum(t), 6) AS share FROM s GROUP BY block""",
    "ambiguous_labels": "WITH " + RECORDS_SQL + """, l AS (SELECT host_smiles, coalesce(contains(lower(host_name), 'calix'), false) AS calix, coalesce(contains(lower(host_name), 'cd'), false) AS cd
        FROM records WHERE host_smiles IS NOT NULL),
      g AS (SELECT host_smiles, count(DISTINCT (calix, cd)) AS n_readings, bool_and(calix) AS c, bool_and(cd) AS d FROM l GROUP BY 1)
      SELECT n_readings, c AND n_readings = 1 AS calix, d AND n_readings = 1 AS cd, count(*) AS n FROM g GROUP BY 1, 2, 3""",
    "best_so_far": """WITH l AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS step, round(avg(o_totalprice), 4) AS loss FROM orders GROUP BY 1, 2),
      b AS (SELECT *, min(loss) OVER w AS best, arg_min(step, loss) OVER w AS best_at FROM l
            WINDOW w AS (PARTITION BY o_orderpriority ORDER BY step ROWS UNBOUNDED PRECEDING))
      SELECT o_orderpriority, step, loss, best, best_at, step - best_at AS waited, step - best_at >= 2 AS stop FROM b""",
}
