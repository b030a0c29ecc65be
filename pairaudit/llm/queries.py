"""Queries of the training-data problems 1, 3, 6, 7 and 8, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.llm import cross_overlap, group_splits, leakage, lookalike, packing
from pairaudit.sources.catalog import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.group_records(table(spark, sf_dir, "folds_host_canonical"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.assign_splits(table(spark, sf_dir, "folds_host_canonical"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each split has its share of the records, within two points, and
    how many groups are divided."""
    return group_splits.split_shares(p1_splits(spark, sf_dir)).drop("n_records")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_overlap.cross_split_pairs(
        table(spark, sf_dir, "folds_host_canonical"), table(spark, sf_dir, "identity_entry")
    )


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_overlap.overlap_report(
        table(spark, sf_dir, "folds_host_canonical"), table(spark, sf_dir, "identity_entry"), table(spark, sf_dir, "clean_condition")
    )


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(documents, "doc_id", packing.token_count(F.col("text"), F.col("n_tokens")))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p6_packing(spark, sf_dir))


def p6_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, tokens and unused space per context-size tier."""
    return packing.tier_report(p6_packing(spark, sf_dir))


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token once, no container above its capacity, only long texts cut."""
    return packing.packing_faults(p6_packing(spark, sf_dir), "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand in a document with other names or numbers too."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), slots="consistent")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items and documents per suite and source."""
    found = p7_found(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    suites = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    return (
        found.join(documents, "doc_id")
        .join(suites, "item_id")
        .groupBy("suite", "source")
        .agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"))
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_shares": p1_shares,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p6_packing": p6_packing,
    "p6_report": p6_report,
    "p6_tiers": p6_tiers,
    "p6_faults": p6_faults,
    "p7_found": p7_found,
    "p7_reparameterised": p7_reparameterised,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_canonical": p8_canonical,
    "p8_classes": p8_classes,
}

_TIES = """
WITH RECURSIVE r AS (
  SELECT CAST(row_index AS BIGINT) AS row_index, CAST(host_id AS BIGINT) AS host,
         CASE WHEN regexp_full_match(trim(guest_id), '[0-9]+') THEN CAST(guest_id AS BIGINT) END AS guest
  FROM folds_host_canonical WHERE lower(trim(role)) IN ('train', 'test') GROUP BY ALL),
hosts AS (SELECT DISTINCT a.host AS a, b.host AS b FROM (SELECT DISTINCT host, guest FROM r) a
          JOIN (SELECT DISTINCT host, guest FROM r) b USING (guest)),
reach(host, least) AS (
  SELECT DISTINCT host, host FROM r
  UNION SELECT h.b, x.least FROM reach x JOIN hosts h ON h.a = x.host WHERE x.least <= h.b)
"""

# the records of one host and guest are alike, so hosts and guests are compared
_OVERLAP = """
WITH f AS (
  SELECT DISTINCT CAST(fold_index AS BIGINT) AS fold, CAST(row_index AS BIGINT) AS row, lower(trim(role)) AS role,
         CAST(host_id AS BIGINT) AS host,
         CASE WHEN regexp_full_match(trim(guest_id), '[0-9]+') THEN CAST(guest_id AS BIGINT) END AS guest,
         lower(canonical_host_sha256) AS hh, lower(canonical_guest_sha256) AS gh
  FROM folds_host_canonical),
e AS (SELECT DISTINCT layer, axis, CAST(identity_key AS BIGINT) AS id, trim(parent_key) AS k FROM identity_entry
      WHERE branch = 'canonical' AND NOT missing AND trim(parent_key) <> ''),
k AS (SELECT fold, row, role, 'exact' AS overlap, '' AS layer, hh AS a, gh AS b FROM f
      WHERE hh IS NOT NULL AND gh IS NOT NULL
      UNION ALL
      SELECT fold, row, role, 'near', h.layer, h.k, g.k FROM f
      JOIN e h ON h.axis = 'host' AND h.id = f.host JOIN e g ON g.axis = 'guest' AND g.id = f.guest AND g.layer = h.layer),
p AS (SELECT x.fold AS fold_index, least(x.row, y.row) AS row_index_1, greatest(x.row, y.row) AS row_index_2,
             min(x.overlap) AS overlap
      FROM k x JOIN k y ON x.fold = y.fold AND x.overlap = y.overlap AND x.layer = y.layer AND x.a = y.a AND x.b = y.b
      WHERE x.role = 'test' AND y.role = 'train' AND x.row <> y.row GROUP BY 1, 2, 3)
"""

_LOOK = """
WITH d AS (
  SELECT doc_id, text, nfc_normalize(translate(nfc_normalize(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g'),
      '[\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\t]', ' ', 'g'),
      '[\\x{2010}\\x{2011}]', '-', 'g'), '\\x{FB01}', 'fi', 'g'), '\\x{FB02}', 'fl', 'g')),
    '{odd}', '{plain}')) AS look
  FROM documents WHERE text <> '')
"""
# Fixed values, written out here apart from the operator's own table: letters
# of other scripts and the Latin letters they look like, then full-width forms.
_ODD = (
    "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝѵӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳµ"
    "ЁёЇїЀѐ"  # composed with their accents, as NFC leaves them
    "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
    "０１２３４５６７８９，．：；－（）［］／＝＋％＂！？＊＇"
)
_PLAIN = (
    "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwvlABEZHIKMNOPTYXovjμ"
    "ËëÏïÈè"
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    """0123456789,.:;-()[]/=+%"!?*''"""
)
_LOOK = _LOOK.replace("{odd}", _ODD).replace("{plain}", _PLAIN)

# the words of documents and items, and their runs of half an item's words
_RUNS = (
    _LOOK
    + ", "
    + _LOOK.strip().removeprefix("WITH").replace("d AS (", "e AS (").replace("doc_id", "item_id").replace("documents", "eval_items")
    + r""",
dw AS (SELECT doc_id, regexp_extract_all(lower(look), '[\p{L}\p{N}]+') AS w FROM d),
iw AS (SELECT item_id, w, (len(w) + 1) // 2 AS n
       FROM (SELECT item_id, regexp_extract_all(lower(look), '[\p{L}\p{N}]+') AS w FROM e) WHERE len(w) > 0),
ir AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM iw)),
dr AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n))
""".replace("\\\\", "\\")
)

ORACLE: dict[str, str] = {
    "p1_found": _TIES
    + """SELECT min(least) AS group_host_id, row_index FROM r JOIN reach USING (host) GROUP BY row_index""",
    "p1_shares": """SELECT split, true AS on_target, CAST(0 AS BIGINT) AS n_divided
    FROM (VALUES ('train'), ('validation'), ('test')) AS s(split)""",
    "p3_found": _OVERLAP + "SELECT * FROM p",
    "p3_report": _OVERLAP
    + """, ends AS (SELECT fold_index, overlap, row_index_1 AS row, row_index_2 AS other FROM p
                    UNION ALL SELECT fold_index, overlap, row_index_2, row_index_1 FROM p),
         s AS (SELECT row_index AS row, arg_max(coalesce(source, ''), loaded_at) AS source FROM clean_condition GROUP BY 1)
    SELECT fold_index, nullif(source, '') AS source, overlap, count(DISTINCT row) AS n_records, count(*) AS n_pairs
    FROM ends LEFT JOIN s USING (row)
    WHERE (fold_index, row) IN (SELECT (fold, row) FROM f WHERE role = 'test') GROUP BY 1, 2, 3""",
    "p6_faults": r"""
    SELECT count(*) AS n_items, CAST(sum(greatest(1, (n + 2047) // 2048)) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS n_tokens,
           CAST(0 AS BIGINT) AS needlessly_cut, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS misplaced
    FROM (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0
                 ELSE coalesce(n_tokens, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\r\f\v]+'))) END AS n
          FROM documents)""",
    "p7_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (n, run)",
    "p7_report": _RUNS
    + """, found AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (n, run))
    SELECT suite, source, count(DISTINCT item_id) AS n_items, count(DISTINCT doc_id) AS n_documents
    FROM found JOIN documents USING (doc_id) JOIN eval_items USING (item_id) GROUP BY suite, source""",
    "p8_found": _LOOK
    + """SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM d a JOIN d b USING (look)
         WHERE a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_classes": _LOOK
    + """SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS n_texts,
                (SELECT count(DISTINCT x.text) FROM d x WHERE x.look = d.look) AS n_spellings
         FROM d WHERE look IN (SELECT look FROM d GROUP BY look HAVING count(DISTINCT text) > 1)
         WINDOW w AS (PARTITION BY look)""",
}
