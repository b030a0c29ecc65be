"""Queries on record curation, similarity and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.functions import numeric, text
from pairaudit.operators import curation, similarity, verify
from pairaudit.plans.common import FOLDS_SQL, PAIRS_SQL, PANEL_SQL, RECORDS_SQL, REPEAT_SQL, PANEL_KEY, folds, pairs, panel, r6, records
from pairaudit.sources.catalog import table
from pairaudit.sources.files import nonfinite_tokens


def curation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose host or guest text is no usable structure, by reason."""
    names = table(spark, sf_dir, "identity_entry").select("branch", "layer", "axis", "identity_key", "parent_key")
    coded = names.withColumn("code", curation.size_code(F.col("parent_key")))
    reason = text.first_match([(F.col("code") == 0, "empty"), (F.col("code") == -1, "missing"), (F.col("code") == -2, "unreadable")], "kept")
    return coded.groupBy("axis", reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("code").alias("checksum"))


def curated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and excluded records with their first reason."""
    kept = curation.curate(records(spark, sf_dir), "host_smiles", "host_name")
    return kept.groupBy("valid", "reason").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


def excluded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded records per host class: counts, distinct names."""
    kept = curation.curate(records(spark, sf_dir), "host_smiles", "host_name").filter("NOT valid")
    label = text.pattern_ladder(F.coalesce("host_name", F.lit("")), curation.HOST_CLASSES, curation.OTHER_CLASS)
    return kept.groupBy(label.alias("host_class"), "reason").agg(F.count("*").alias("n"), F.countDistinct("host_name").alias("n_names"))


def class_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = text.pattern_ladder(F.coalesce("host_name", F.lit("")), curation.HOST_CLASSES, curation.OTHER_CLASS)
    mega = F.coalesce(F.lower("host_name").rlike("cyclodextrin|cucurbit"), F.lit(False))
    ring = F.regexp_extract(F.coalesce("host_name", F.lit("")), r"\[(\d+)\]", 1)
    out = records(spark, sf_dir).select(label.alias("host_class"), mega.alias("mega"), ring.alias("ring"), "y")
    return out.groupBy("host_class", "mega", "ring").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("mean_y"))


def two_track_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, on the structure track or the name track."""
    kept = curation.curate(records(spark, sf_dir), "host_smiles", "guest_smiles")
    track = F.when(F.col("valid") & F.col("host_name").isNotNull(), "structure_and_name").when(F.col("valid"), "structure").otherwise("name")
    small = (F.col("host_code") < 6).alias("small")
    return kept.groupBy(track.alias("track"), small).agg(F.count("*").alias("n"), F.sum("row_index").alias("checksum"))


def token_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "host_id_map").filter("host_names IS NOT NULL")
    return names.groupBy(F.size(F.split("host_names", r"\|")).alias("n_tokens")).agg(F.count("*").alias("n"))


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised variants of each name field."""
    names = table(spark, sf_dir, "host_id_map").select("host_id", "host_names").distinct()
    tokens = text.name_tokens(F.coalesce("host_names", F.lit("")))
    calix = F.exists(tokens, lambda t: t.contains("calix") | (t.contains("resorcin") & t.contains("arene")))
    blocked = F.exists(tokens, lambda t: F.forall(F.array(*map(F.lit, curation.BLOCKED_FAMILY_WORDS)), lambda w: ~t.contains(w)) == F.lit(False))
    return names.select("host_id", F.size(tokens).alias("n_variants"), F.array_join(tokens, "; ").alias("variants"), calix.alias("any_calix"), blocked.alias("blocked"))


def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose name says one family and whose family says another."""
    label = text.pattern_ladder(F.coalesce("host_name", F.lit("")), curation.FAMILIES, "other")
    rows = records(spark, sf_dir).filter("family IS NOT NULL").select(label.alias("named"), "family")
    status = F.when(F.col("named") == "other", "NO_NAME_EVIDENCE").when(F.col("named") == F.col("family"), "AGREES").otherwise("CONFLICT")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def joined_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    reasons = text.join_reasons(
        F.when(F.col("host_name").isNull(), "no name"), F.when(F.col("source").isNull(), "no source"), F.when(F.col("y").isNull(), "no target"),
        F.when(F.lower("temp_bucket") == "unknown", "temperature unknown"),
    )
    return r.groupBy(reasons.alias("reasons")).agg(F.count("*").alias("n"))


def strict_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as canonical integers, roles as booleans, one-axis exclusivity."""
    f = table(spark, sf_dir, "folds_host_canonical")
    index = text.parse_index(F.col("guest_id"))
    is_test = text.parse_bool(F.lower(F.trim("role")).isin("test").cast("string"), text.MASK_WORDS)
    one_axis = text.blank(F.col("canonical_guest_sha256")) != text.blank(F.col("canonical_host_sha256"))
    return f.groupBy(index.isNotNull().alias("known_guest"), is_test.alias("is_test"), one_axis.alias("one_axis")).agg(F.count("*").alias("n"))


def parsed_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of three columns under both dialects of booleans."""
    r = table(spark, sf_dir, "host_id_map").select(F.explode(F.array(F.col("n_host_names").cast("string"), F.col("deleted_at").isNull().cast("string"), "host_names", F.lit(" Y "))).alias("cell"))
    a, b = text.parse_bool(F.col("cell"), text.TABLE_WORDS, strict=False), text.parse_bool(F.col("cell"), text.MASK_WORDS, strict=False)
    return r.groupBy(a.alias("of_table"), b.alias("of_mask")).agg(F.count("*").alias("n"))


def nonfinite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nonfinite_tokens(table(spark, sf_dir, "predictions"), ["y_true", "y_pred", "host_id", "seed"])


def missing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    share = lambda c: r6(F.avg(c.cast("int")))
    return r.groupBy("source").agg(
        F.count("*").alias("n"), share(F.col("host_name").isNull()).alias("no_name"), share(F.col("temp_bucket") == "unknown").alias("no_temperature"),
        share(F.col("ph_bucket") == "unknown").alias("no_ph"),
    )


def replicate_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curation.replicate_spread(pairs(spark, sf_dir), ["host", "guest"], "y")
    return out.select("n_groups", "n_rows", r6("median_range").alias("median_range"), r6("mean_sd").alias("mean_sd"))


def sigma_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records(spark, sf_dir).filter("host_smiles IS NOT NULL AND guest_smiles IS NOT NULL")
    out = curation.sigma_decomposition(kept, ["host_smiles", "guest_smiles"], ["solvent_bucket", "temp_bucket", "ph_bucket"], "y")
    return out.select("kind", "n_groups", r6("mean_sd").alias("mean_sd"))


def cross_condition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = pairs(spark, sf_dir).groupBy("host", "guest").agg(F.count("*").alias("n"), F.countDistinct("cond1", "cond2").alias("k"), F.bool_or(F.col("source") == "R").alias("any_r"))
    return groups.filter("n > 1").groupBy("n", "any_r").agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_cross"))


def describe_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curation.describe(pairs(spark, sf_dir), ["source"], "y")
    return out.select("source", "n", *[r6(c).alias(c) for c in ("mean", "sd", "least", "q25", "q50", "q75", "greatest")])


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algebraic pair columns of supplier and part figures, averaged."""
    p = pairs(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"), "s_acctbal"), "host")
    p = p.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("guest"), "p_retailprice", "p_size"), "guest")
    columns = curation.pair_features([F.col("s_acctbal") / 1000], [F.col("p_retailprice") / 1000])
    flags = curation.one_hot(p.withColumns(columns), "source", ["A", "N", "R"])
    return flags.groupBy("cond1").agg(*[F.round(F.avg(c), 5).alias(c) for c in columns], *[F.sum(f"source_{s}").alias(f"source_{s}") for s in ("A", "N", "R")])


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen name and family of each structure, and all its families."""
    r = records(spark, sf_dir).filter("host_smiles IS NOT NULL")
    first = r.groupBy("host_smiles").agg(
        F.min_by("host_name", F.when(F.col("host_name").isNotNull(), F.col("row_index"))).alias("first_name"),
        F.min_by("family", F.when(F.col("family").isNotNull(), F.col("row_index"))).alias("first_family"),
        text.sorted_set_text(F.collect_set("family")).alias("families"),
        F.count("*").alias("n"),
    )
    return first


def condition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy(F.coalesce(F.lower("solvent_bucket"), F.lit("?")).alias("solvent")).pivot("ph_bucket", ["acidic", "basic", "neutral", "unknown"]).agg(F.count(F.lit(1)))


# similarity

WIDTH = 64


def _bits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    return similarity.with_words(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH, "label")


def bit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, words = _bits(spark, sf_dir)
    on = sum((F.bit_count(w) for w in words), F.lit(0))
    return bits.groupBy("label").agg(F.count("*").alias("n"), F.sum(on).alias("n_on"), F.max(on).alias("most"))


def _stated(bits: DataFrame) -> DataFrame:
    """The stated query set: every id divisible by 100."""
    return bits.filter("vec_id % 100 = 0")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of each stated query, over all rows."""
    bits, words = _bits(spark, sf_dir)
    top = similarity.top_similar(_stated(bits), bits, "vec_id", words, 5)
    return top.select("query", "match", r6("similarity").alias("similarity"), "rank")


def knn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, words = _bits(spark, sf_dir)
    top = similarity.top_similar(_stated(bits), bits, "vec_id", words, 5)
    out = similarity.knn_predict(top, bits, "vec_id", "label")
    return out.select("query", r6("y_true").alias("y_true"), r6("y_pred").alias("y_pred"))


def similarity_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated queries by their greatest similarity to any other row."""
    bits, words = _bits(spark, sf_dir)
    best = similarity.top_similar(_stated(bits), bits, "vec_id", words, 1)
    return best.groupBy(similarity.stratum(F.col("similarity")).alias("stratum")).agg(F.count("*").alias("n"), r6(F.avg("similarity")).alias("mean"))


# verification


def validated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"), "s_name", "s_nationkey")
    found = verify.lookup(pairs(spark, sf_dir), hosts, ["host"], ["s_name", "s_nationkey"])
    return found.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("s_name").isNull()).alias("n_unresolved"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicate_keys(table(spark, sf_dir, "predictions"), PANEL_KEY)


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, rounded target) pairs that one copy has more often."""
    columns = ["row_index", F.round("y_true", 6).alias("y")]
    return verify.multiset_difference(panel(spark, sf_dir), panel(spark, sf_dir, "predictions_repeat"), columns)


def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.frame_diff(panel(spark, sf_dir), panel(spark, sf_dir, "predictions_repeat"), PANEL_KEY, ["host_id", "guest_id", "y_true"])


def misaligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.misaligned(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "predictions_repeat"), PANEL_KEY, ["fold_index"])


def repeat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"mean": 0.002, "rmse": 0.05, "p95": 1e-9, "max": 0.5}
    out = verify.repeat_report(panel(spark, sf_dir), panel(spark, sf_dir, "predictions_repeat"), PANEL_KEY, ["split", "block_id", "model"], "y_pred", limits)
    return out.select("split", "block_id", "model", "metric", r6("value").alias("value"), "threshold", "status")


def roster_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, block) units of either copy that the other does not have."""
    a, b = (table(spark, sf_dir, t).select("model", "block_id", "fold_index", "seed") for t in ("predictions", "predictions_repeat"))
    return verify.roster_faults(a, b, ["model", "block_id", "fold_index", "seed"])


def reference_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against folds: same host and guest per record?"""
    known = folds(spark, sf_dir).groupBy("row_index").agg(F.max("host").alias("host"), F.max("guest").alias("guest"))
    p = panel(spark, sf_dir).groupBy("row_index", "host_id", "guest_id").agg(F.count("*").alias("n")).join(known, "row_index", "left")
    unknown = lambda c: F.when(F.col(c) >= 0, F.col(c))
    state = (
        F.when(F.col("host").isNull(), "no_record").when(~unknown("host_id").eqNullSafe(F.col("host")), "host_differs")
        .when(~unknown("guest_id").eqNullSafe(F.col("guest")), "guest_differs").otherwise("same")
    )
    return p.groupBy(state.alias("state")).agg(F.sum("n").alias("n"))


def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the number that is their natural order."""
    blocks = panel(spark, sf_dir).groupBy("split", "block_id").agg(F.count("*").alias("n"))
    return blocks.withColumn("number", text.numeric_suffix(F.col("block_id"))).withColumn("wide", F.col("n") > 100)


def ulp_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared finite predictions of both copies within 8 ulps, and closely."""
    a = panel(spark, sf_dir).select(*PANEL_KEY, F.col("y_pred").alias("a"))
    b = panel(spark, sf_dir, "predictions_repeat").select(*PANEL_KEY, F.col("y_pred").alias("b"))
    both = a.join(b, PANEL_KEY).filter(numeric.finite(F.col("a")) & numeric.finite(F.col("b")))
    return both.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(numeric.within_ulps(F.col("a"), F.col("b"))).alias("n_within"),
        F.count_if(numeric.is_close(F.col("a"), F.col("b"))).alias("n_close"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        curation_reasons, curated_records, excluded_summary, class_ladder, two_track_manifest, token_count_distribution,
        name_variants, name_conflicts, joined_reasons, strict_parses, parsed_booleans, nonfinite_cells, missing_shares, replicate_spread,
        sigma_decomposition, cross_condition_groups, describe_target, pair_features, entity_names, condition_features,
        bit_counts, nearest_vectors, knn_predictions, similarity_strata, validated_lookup, duplicate_keys,
        multiset_difference, frame_diff, misaligned_rows, repeat_report, roster_check, reference_cycle, order_check,
        ulp_agreement,
    )
}


def _code(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN -1 WHEN trim({c}) = '' THEN 0
    WHEN NOT regexp_matches(trim({c}), '^[A-Za-z0-9@+\\-\\[\\]()=#/\\\\.%]+$') THEN -2
    ELSE len(regexp_extract_all(trim({c}), 'Cl|Br|[BCNOPSFI]|[cnops]')) END"""


# the published ladders, written out apart from the operator's own patterns
_CLASS = """CASE WHEN contains(n, 'serum albumin') OR trim(n) = 'hsa' THEN 'protein (HSA)'
  WHEN contains(n, 'zeolite') THEN 'inorganic zeolite'
  WHEN contains(n, 'rotaxane') THEN 'mechanically interlocked (rotaxane)'
  WHEN contains(n, 'pillar') THEN 'pillararene (SMILES not shipped)'
  WHEN contains(n, 'calix') THEN 'calixarene (SMILES not shipped)'
  WHEN contains(n, 'cucurbit') OR contains(n, 'cb[') OR contains(n, 'cb6') OR contains(n, 'cb8') THEN 'functionalized cucurbituril (SMILES not shipped)'
  WHEN contains(n, 'cyclodext') THEN 'cyclodextrin (SMILES not shipped)'
  ELSE 'other (SMILES not shipped)' END"""
_FAMILY = r"""CASE WHEN contains(n, 'cucurbit') OR regexp_matches(n, '(^|[^\p{L}\p{N}_])cb\s*\[?\p{Nd}') THEN 'cucurbituril'
  WHEN contains(n, 'cyclodext') OR regexp_matches(n, '(^|[^\p{L}\p{N}_])[abgαβγ]-?cd($|[^\p{L}\p{N}_])') THEN 'cyclodextrin'
  WHEN contains(n, 'calix') THEN 'calixarene' WHEN contains(n, 'pillar') THEN 'pillararene' WHEN contains(n, 'cavitand') THEN 'cavitand'
  WHEN contains(n, 'cyclophane') THEN 'cyclophane' WHEN contains(n, 'crown') THEN 'crown_ether' ELSE 'other' END"""
_NAMED = "(SELECT *, lower(coalesce(host_name, '')) AS n FROM {0})"
_REASON = "CASE WHEN h = 0 THEN 'host_empty' WHEN h = -1 THEN 'host_missing' WHEN h = -2 THEN 'host_unreadable' WHEN g = 0 THEN 'guest_empty' WHEN g = -1 THEN 'guest_missing' WHEN g = -2 THEN 'guest_unreadable' END"
_CURATED = RECORDS_SQL + f""", c AS (SELECT *, {_code("host_smiles")} AS h, {_code("host_name")} AS g FROM records),
v AS (SELECT *, h >= 1 AND g >= 1 AS valid, CASE WHEN NOT (h >= 1 AND g >= 1) THEN {_REASON} END AS reason FROM c)"""
_BITS = " | ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN 1::BIGINT << {i % 32} ELSE 0 END)" for i in range(32))
_BITS2 = " | ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN 1::BIGINT << {i % 32} ELSE 0 END)" for i in range(32, 64))
_SIMILAR = f"""bits AS (SELECT vec_id, label, {_BITS} AS w0, {_BITS2} AS w1 FROM embeddings),
sim AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match) AS rank FROM (
  SELECT q.vec_id AS query, r.vec_id AS match, q.label AS y_true, r.label AS y,
    coalesce((bit_count(q.w0 & r.w0) + bit_count(q.w1 & r.w1)) / nullif(bit_count(q.w0 | r.w0) + bit_count(q.w1 | r.w1), 0), 0.0) AS similarity
  FROM bits q JOIN bits r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0))"""
_TWO = "WITH " + PANEL_SQL + ", " + REPEAT_SQL + """, two AS (
  SELECT split, block_id, model, row_index, a.y_pred AS a, b.y_pred AS b, a.y_true AS ya, b.y_true AS yb,
    a.host_id AS ha, b.host_id AS hb, a.guest_id AS ga, b.guest_id AS gb, a.row_index IS NOT NULL AND b.row_index IS NOT NULL AS shared
  FROM panel a FULL JOIN repeat_panel b USING (split, block_id, model, row_index))"""
_ULP = "pow(2, floor(log2(greatest(abs({0}), 1e-300))) - 52)"
_YA, _YB = ("CASE WHEN NOT isnan({0}) THEN {0} END".format(c) for c in ("ya", "yb"))

ORACLE = {
    "curation_reasons": f"""SELECT axis, CASE code WHEN 0 THEN 'empty' WHEN -1 THEN 'missing' WHEN -2 THEN 'unreadable' ELSE 'kept' END AS reason,
      count(*) AS n, CAST(sum(code) AS BIGINT) AS checksum FROM (SELECT axis, {_code("parent_key")} AS code FROM identity_entry) GROUP BY 1, 2""",
    "curated_records": "WITH " + _CURATED + " SELECT valid, reason, count(*) AS n, min(row_index) AS first_row FROM v GROUP BY 1, 2",
    "excluded_summary": "WITH " + _CURATED + f""" SELECT {_CLASS} AS host_class, reason, count(*) AS n,
      count(DISTINCT host_name) AS n_names FROM {_NAMED.format("v")} WHERE NOT valid GROUP BY 1, 2""",
    "class_ladder": "WITH " + RECORDS_SQL + f""" SELECT {_CLASS} AS host_class,
      coalesce(regexp_matches(lower(host_name), 'cyclodextrin|cucurbit'), false) AS mega,
      regexp_extract(coalesce(host_name, ''), '\\[(\\d+)\\]', 1) AS ring, count(*) AS n, round(avg(y), 6) AS mean_y FROM {_NAMED.format('records')} GROUP BY 1, 2, 3""",
    "two_track_manifest": "WITH " + RECORDS_SQL + f""", c AS (SELECT *, {_code("host_smiles")} AS h, {_code("guest_smiles")} AS g FROM records)
      SELECT CASE WHEN h >= 1 AND g >= 1 AND host_name IS NOT NULL THEN 'structure_and_name' WHEN h >= 1 AND g >= 1 THEN 'structure' ELSE 'name' END AS track,
        h < 6 AS small, count(*) AS n, CAST(sum(row_index) AS BIGINT) AS checksum FROM c GROUP BY 1, 2""",
    "token_count_distribution": """SELECT CAST(len(string_split(host_names, '|')) AS INTEGER) AS n_tokens, count(*) AS n FROM host_id_map
      WHERE host_names IS NOT NULL GROUP BY 1""",
    "name_variants": """WITH t AS (SELECT DISTINCT host_id, host_names FROM host_id_map),
      v AS (SELECT host_id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(host_names, ''), '|'),
        lambda x: lower(trim(x))), lambda x: x <> ''))) AS a FROM t)
      SELECT host_id, CAST(len(a) AS INTEGER) AS n_variants, array_to_string(a, '; ') AS variants,
        len(list_filter(a, lambda x: contains(x, 'calix') OR (contains(x, 'resorcin') AND contains(x, 'arene')))) > 0 AS any_calix,
        len(list_filter(a, lambda x: regexp_matches(x, 'pillar|cucurbit|cyclodextrin|bambus|tweezer|cyclophane|naphthotube|glycoluril|crown|cryptand|cryptophane|corral|oxatub|zorb|exbox|sugammadex|viologen|paraquat|positand'))) > 0 AS blocked FROM v""",
    "name_conflicts": "WITH " + RECORDS_SQL + f""", l AS (SELECT family, {_FAMILY} AS named FROM {_NAMED.format("records")} WHERE family IS NOT NULL)
      SELECT CASE WHEN named = 'other' THEN 'NO_NAME_EVIDENCE' WHEN named = family THEN 'AGREES' ELSE 'CONFLICT' END AS status, count(*) AS n FROM l GROUP BY 1""",
    "joined_reasons": "WITH " + RECORDS_SQL + """ SELECT concat_ws(' | ', CASE WHEN host_name IS NULL THEN 'no name' END, CASE WHEN source IS NULL THEN 'no source' END,
      CASE WHEN y IS NULL THEN 'no target' END, CASE WHEN lower(temp_bucket) = 'unknown' THEN 'temperature unknown' END) AS reasons, count(*) AS n FROM records GROUP BY 1""",
    "strict_parses": """SELECT coalesce(regexp_full_match(guest_id, '0|[1-9][0-9]*'), false) AS known_guest, lower(trim(role)) = 'test' AS is_test,
      (coalesce(trim(canonical_guest_sha256), '') = '') <> (coalesce(trim(canonical_host_sha256), '') = '') AS one_axis, count(*) AS n
      FROM folds_host_canonical GROUP BY 1, 2, 3""",
    "parsed_booleans": """WITH c AS (SELECT unnest([CAST(n_host_names AS VARCHAR), CAST(deleted_at IS NULL AS VARCHAR), host_names, ' Y ']) AS cell FROM host_id_map)
      SELECT CASE WHEN lower(trim(cell)) IN ('1', 'true', 'yes', 'y') THEN true WHEN cell IS NULL OR lower(trim(cell)) IN ('0', 'false', 'no', 'n', '') THEN false END AS of_table,
        CASE WHEN lower(cell) IN ('true', '1') THEN true WHEN lower(cell) IN ('false', '0') THEN false END AS of_mask, count(*) AS n FROM c GROUP BY 1, 2""",
    "nonfinite_cells": """SELECT 'y_true' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE NOT isfinite(y_true)) AS n_nonfinite FROM predictions
      UNION ALL SELECT 'y_pred', count(*), count(*) FILTER (WHERE NOT isfinite(y_pred)) FROM predictions
      UNION ALL SELECT 'host_id', count(*), 0 FROM predictions UNION ALL SELECT 'seed', count(*), 0 FROM predictions""",
    "missing_shares": "WITH " + RECORDS_SQL + """ SELECT source, count(*) AS n, round(avg(CAST(host_name IS NULL AS INTEGER)), 6) AS no_name,
      round(avg(CAST(temp_bucket = 'unknown' AS INTEGER)), 6) AS no_temperature, round(avg(CAST(ph_bucket = 'unknown' AS INTEGER)), 6) AS no_ph FROM records GROUP BY 1""",
    "replicate_spread": "WITH " + PAIRS_SQL + """, g AS (SELECT count(y) AS n, max(y) - min(y) AS r, stddev_samp(y) AS sd FROM pairs GROUP BY host, guest)
      SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, round(quantile_cont(r, 0.5), 6) AS median_range, round(avg(sd), 6) AS mean_sd FROM g WHERE n > 1""",
    "sigma_decomposition": "WITH " + RECORDS_SQL + """, k AS (SELECT * FROM records WHERE host_smiles IS NOT NULL AND guest_smiles IS NOT NULL AND y IS NOT NULL),
      s AS (SELECT count(*) AS n, stddev_samp(y) AS sd, count(DISTINCT coalesce(solvent_bucket, '?') || '|' || coalesce(temp_bucket, '?') || '|' || coalesce(ph_bucket, '?')) AS k
            FROM k GROUP BY host_smiles, guest_smiles),
      t AS (SELECT count(*) AS n, stddev_samp(y) AS sd FROM k GROUP BY host_smiles, guest_smiles, solvent_bucket, temp_bucket, ph_bucket)
      SELECT 'same_pair' AS kind, count(*) AS n_groups, round(avg(sd), 6) AS mean_sd FROM s WHERE n > 1
      UNION ALL SELECT 'true_replicate', count(*), round(avg(sd), 6) FROM t WHERE n > 1
      UNION ALL SELECT 'cross_condition', count(*), round(avg(sd), 6) FROM s WHERE n > 1 AND k > 1""",
    "cross_condition_groups": "WITH " + PAIRS_SQL + """, g AS (SELECT count(*) AS n, count(DISTINCT (cond1, cond2)) AS k, bool_or(source = 'R') AS any_r FROM pairs GROUP BY host, guest)
      SELECT n, any_r, count(*) AS n_groups, count(*) FILTER (WHERE k > 1) AS n_cross FROM g WHERE n > 1 GROUP BY 1, 2""",
    "describe_target": "WITH " + PAIRS_SQL + """ SELECT source, count(y) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(min(y), 6) AS least,
      round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.5), 6) AS q50, round(quantile_cont(y, 0.75), 6) AS q75, round(max(y), 6) AS greatest FROM pairs GROUP BY 1""",
    "pair_features": "WITH " + PAIRS_SQL + """, f AS (SELECT p.*, s_acctbal / 1000 AS h, p_retailprice / 1000 AS g FROM pairs p JOIN supplier ON s_suppkey = host JOIN part ON p_partkey = guest)
      SELECT cond1, round(avg(h + g), 5) AS sum_0, round(avg(h * g), 5) AS product_0, round(avg(abs(h - g)), 5) AS gap_0,
        round(avg(g / CASE WHEN abs(h) < 1e-6 THEN 1e-6 ELSE h END), 5) AS ratio_0, count(*) FILTER (WHERE source = 'A') AS "source_A",
        count(*) FILTER (WHERE source = 'N') AS "source_N", count(*) FILTER (WHERE source = 'R') AS "source_R" FROM f GROUP BY cond1""",
    "entity_names": "WITH " + RECORDS_SQL + """ SELECT host_smiles, arg_min(host_name, row_index) FILTER (WHERE host_name IS NOT NULL) AS first_name,
      arg_min(family, row_index) FILTER (WHERE family IS NOT NULL) AS first_family,
      '{' || coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') || '}' AS families, count(*) AS n FROM records WHERE host_smiles IS NOT NULL GROUP BY 1""",
    "condition_features": "WITH " + RECORDS_SQL + """ SELECT coalesce(lower(solvent_bucket), '?') AS solvent, nullif(count(*) FILTER (WHERE ph_bucket = 'acidic'), 0) AS acidic,
      nullif(count(*) FILTER (WHERE ph_bucket = 'basic'), 0) AS basic, nullif(count(*) FILTER (WHERE ph_bucket = 'neutral'), 0) AS neutral,
      nullif(count(*) FILTER (WHERE ph_bucket = 'unknown'), 0) AS unknown FROM records GROUP BY 1""",
    "bit_counts": "WITH " + _SIMILAR + """ SELECT label, count(*) AS n, CAST(sum(bit_count(w0) + bit_count(w1)) AS BIGINT) AS n_on, CAST(max(bit_count(w0) + bit_count(w1)) AS INTEGER) AS most FROM bits GROUP BY 1""",
    "nearest_vectors": "WITH " + _SIMILAR + " SELECT query, match, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM sim WHERE rank <= 5",
    "knn_predictions": "WITH " + _SIMILAR + """ SELECT query, round(CAST(any_value(y_true) AS DOUBLE), 6) AS y_true,
      round(sum((similarity + 1e-6) * y) / sum(similarity + 1e-6), 6) AS y_pred FROM sim WHERE rank <= 5 GROUP BY query""",
    "similarity_strata": "WITH " + _SIMILAR + """ SELECT CASE WHEN similarity < 0.4 THEN '<0.4' WHEN similarity <= 0.7 THEN '0.4-0.7' ELSE '>0.7' END AS stratum,
      count(*) AS n, round(avg(similarity), 6) AS mean FROM sim WHERE rank = 1 GROUP BY 1""",
    "validated_lookup": "WITH " + PAIRS_SQL + " SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE s_name IS NULL) AS n_unresolved FROM pairs LEFT JOIN supplier ON s_suppkey = host GROUP BY 1",
    "duplicate_keys": "SELECT split, block_id, model, row_index, count(*) AS n_rows FROM predictions GROUP BY ALL HAVING n_rows > 1",
    "multiset_difference": "WITH " + PANEL_SQL + ", " + REPEAT_SQL + """ SELECT row_index, y, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM (
      SELECT row_index, round(y_true, 6) AS y, 1 AS l, 0 AS r FROM panel UNION ALL SELECT row_index, round(y_true, 6), 0, 1 FROM repeat_panel) GROUP BY 1, 2 HAVING sum(l) <> sum(r)""",
    "frame_diff": _TWO + f""" SELECT '*row*' AS "column", count(*) AS n_compared, count(*) FILTER (WHERE NOT shared) AS n_differ FROM (
        SELECT EXISTS (SELECT 1 FROM panel p WHERE p.split = t.split AND p.block_id = t.block_id AND p.model = t.model AND p.row_index = t.row_index)
           AND EXISTS (SELECT 1 FROM repeat_panel p WHERE p.split = t.split AND p.block_id = t.block_id AND p.model = t.model AND p.row_index = t.row_index) AS shared FROM two t)
      UNION ALL SELECT 'host_id', count(*), count(*) FILTER (WHERE a.host_id IS DISTINCT FROM b.host_id) FROM panel a JOIN repeat_panel b USING (split, block_id, model, row_index)
      UNION ALL SELECT 'guest_id', count(*), count(*) FILTER (WHERE a.guest_id IS DISTINCT FROM b.guest_id) FROM panel a JOIN repeat_panel b USING (split, block_id, model, row_index)
      UNION ALL SELECT 'y_true', count(*), count(*) FILTER (WHERE (ya IS NULL) <> (yb IS NULL) OR CASE WHEN isinf(ya) OR isinf(yb) THEN ya <> yb ELSE abs(ya - yb) > 8 * {_ULP.format("yb")} END) FROM (
        SELECT {_YA.replace("ya", "a.y_true")} AS ya, {_YB.replace("yb", "b.y_true")} AS yb FROM panel a JOIN repeat_panel b USING (split, block_id, model, row_index))""",
    "misaligned_rows": """WITH a AS (SELECT split, block_id, model, row_index, count(*) AS na, min(fold_index) AS fa FROM predictions GROUP BY ALL),
      b AS (SELECT split, block_id, model, row_index, count(*) AS nb, min(fold_index) AS fb FROM predictions_repeat GROUP BY ALL)
      SELECT * FROM (SELECT split, block_id, model, row_index, CASE WHEN na IS NULL THEN 'missing_left' WHEN nb IS NULL THEN 'missing_right'
        WHEN na > 1 OR nb > 1 THEN 'repeated' WHEN fa IS DISTINCT FROM fb THEN 'identity' END AS fault FROM a FULL JOIN b USING (split, block_id, model, row_index)) WHERE fault IS NOT NULL""",
    "repeat_report": _TWO + """, d AS (SELECT split, block_id, model, CASE WHEN isfinite(a.y_pred) THEN a.y_pred END AS a, CASE WHEN isfinite(b.y_pred) THEN b.y_pred END AS b
        FROM panel a FULL JOIN repeat_panel b USING (split, block_id, model, row_index)),
      u AS (SELECT split, block_id, model, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS odd, avg(abs(a - b)) AS mean_, sqrt(avg((a - b) * (a - b))) AS rmse,
              quantile_cont(abs(a - b), 0.95) AS p95, max(abs(a - b)) AS max_ FROM d GROUP BY 1, 2, 3),
      m AS (SELECT split, block_id, model, odd, 'mean' AS metric, mean_ AS value, 0.002 AS threshold FROM u
            UNION ALL SELECT split, block_id, model, odd, 'rmse', rmse, 0.05 FROM u
            UNION ALL SELECT split, block_id, model, odd, 'p95', p95, 1e-9 FROM u UNION ALL SELECT split, block_id, model, odd, 'max', max_, 0.5 FROM u)
      SELECT split, block_id, model, metric, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN odd > 0 THEN 'FAIL_ASYMMETRIC_DEFINEDNESS'
        WHEN value IS NULL THEN 'UNKNOWN_SYMMETRIC' WHEN value <= threshold THEN 'PASS' ELSE 'FAIL_THRESHOLD' END AS status FROM m""",
    "roster_check": """WITH a AS (SELECT DISTINCT model, block_id, fold_index, coalesce(seed, -999) AS seed FROM predictions),
      b AS (SELECT DISTINCT model, block_id, fold_index, coalesce(seed, -999) AS seed FROM predictions_repeat)
      SELECT model, block_id, fold_index, nullif(seed, -999) AS seed, 'foreign' AS fault FROM (FROM a EXCEPT FROM b)
      UNION ALL SELECT model, block_id, fold_index, nullif(seed, -999), 'missing' FROM (FROM b EXCEPT FROM a)""",
    "reference_cycle": "WITH " + PANEL_SQL + ", " + FOLDS_SQL + """, k AS (SELECT row_index, max(host) AS host, max(guest) AS guest FROM folds GROUP BY 1)
      SELECT CASE WHEN host IS NULL THEN 'no_record' WHEN CASE WHEN host_id >= 0 THEN host_id END IS DISTINCT FROM host THEN 'host_differs'
        WHEN CASE WHEN guest_id >= 0 THEN guest_id END IS DISTINCT FROM guest THEN 'guest_differs' ELSE 'same' END AS state, count(*) AS n
      FROM panel LEFT JOIN k USING (row_index) GROUP BY 1""",
    "order_check": "WITH " + PANEL_SQL + """ SELECT split, block_id, count(*) AS n, CAST(regexp_extract(block_id, '_(\\d+)$', 1) AS INTEGER) AS number, count(*) > 100 AS wide FROM panel GROUP BY 1, 2""",
    "ulp_agreement": _TWO + f""" SELECT model, count(*) AS n, count(*) FILTER (WHERE abs(a - b) <= 8 * {_ULP.format("b")}) AS n_within,
      count(*) FILTER (WHERE abs(a - b) <= 1e-12 * greatest(abs(a), abs(b))) AS n_close FROM two WHERE isfinite(a) AND isfinite(b) GROUP BY 1""",
}
