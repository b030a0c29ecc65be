"""Same or near-same records across splits (problem 3).

What a record is, is written in texts: its canonical hashes of host and guest,
and the parent keys of host and guest in each identity layer (one text for each
pair of keys where repeated entries carry several).  Each distinct text gets a
256-bit *similarity hash*: every run of four characters of either key votes on
every bit, so equal texts have equal fingerprints and alike texts differ in few
bits.  A fingerprint is cut into ``radius + 1`` segments; two that lie within a
Hamming distance of ``radius`` share at least one whole segment, so a self-join
on (segment number, segment) finds every such pair.  A candidate is kept by the
first segment it shares, within the radius, if one text stands in a test record
and the other in a train record of the same fold; then the texts themselves are
compared (one less the edit distance over the length, of host and of guest).

The join sees each distinct text once, so no record, key or copy is a hot key
in it, however often it occurs.  The links of texts are then carried to classes
of records (records of one host and guest share all their texts) by layer, and
rows are paired only in ``cross_split_pairs``, whose result they are; the report
counts by class.  Which folds a text stands in is a bit mask.

``least_similarity=1`` asks for equal keys, which is what makes a record near
in this data; equal texts are at distance 0, so none is missed.  Below 1 the
pairs within ``radius`` are found, and only those: a fingerprint of short keys
moves by some bits per edit, so the radius bounds the recall.

Defined results
- only roles ``test`` and ``train`` count, case and padding ignored;
- unknown hashes (null, blank) match nothing; unknown ids (null, blank,
  negative) have no parent keys; entries that are missing or have a null or
  blank parent key equal nothing; of repeated entries all distinct usable keys
  of the id and layer stand;
- a pair is ``exact`` if both canonical hashes are known and equal, else
  ``near``; each pair of records comes once per fold, smaller id first, and
  never pairs a record with itself;
- repeated rows count once; texts of any length are hashed whole; empty tables
  give no rows; more than 10,000 folds or 1,000 layers are refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairaudit.llm.group_splits import known_id
from pairaudit.operators.splits import block_list
from pairaudit.session import Materialized

CLASS = ["host", "guest", "hh", "gh"]
BITS, GRAM = 256, 4
#: The fingerprint as columns; segments of 64 bits keep chance agreement of
#: unlike texts out of the join at any number of texts.
WORDS = [f"p{i}" for i in range(BITS // 64)]
RADIUS = 3
#: The layer that stands for the canonical hashes.
EXACT = -1


# --- fingerprints


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each byte, a 64-bit word with each of its bits in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _votes(texts: Sequence[str], side: int, at_once: int = 1 << 15) -> np.ndarray:
    """For each text and bit, the runs of characters for it less those against."""
    pad = b"\0" * (GRAM - 1)
    raw = [pad + t.encode("utf-8", "surrogatepass") + pad for t in texts]
    sizes = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    gram = sum((flat[k : len(flat) - GRAM + 1 + k] << np.uint64(8 * k) for k in range(GRAM)), np.uint64(side << 40))
    owner = np.repeat(np.arange(len(raw)), sizes)[: len(gram)]
    place = np.arange(len(gram)) - (np.cumsum(sizes) - sizes)[owner]
    inside = place + GRAM <= sizes[owner]
    gram, owner, place = gram[inside], owner[inside], place[inside]
    out = np.zeros((len(raw), BITS), dtype=np.int64)
    for a in range(0, len(gram), at_once):
        g, o = gram[a : a + at_once], owner[a : a + at_once]
        words = np.stack([_mix(g * np.uint64(2 * i + 1) + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) for i in range(BITS // 64)], axis=1)
        # summed in bytes, so in stretches of at most 255
        first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (place[a + 1 : a + len(g)] % 255 == 0)])
        ones = np.add.reduceat(_LANES[words.view(np.uint8)], first, axis=0).view(np.uint8)
        n = np.diff(np.r_[first, len(o)])
        np.add.at(out, o[first], 2 * ones.astype(np.int64) - n[:, None])
    return out


def fingerprints(hosts: Sequence[str], guests: Sequence[str]) -> np.ndarray:
    """Bits of the similarity hash of each (host, guest) text, one row each."""

    def side(texts: Sequence[str], tag: int) -> np.ndarray:
        coded = pa.array(texts, pa.string()).dictionary_encode()
        return _votes(coded.dictionary.to_pylist(), tag)[coded.indices.to_numpy()]

    if not len(hosts):
        return np.zeros((0, BITS), dtype=bool)
    return side(hosts, 1) + side(guests, 2) > 0


def segments(bits: np.ndarray, radius: int) -> np.ndarray:
    """``radius + 1`` integers a row: the segments of the fingerprint."""
    cuts = np.linspace(0, BITS, radius + 2).astype(int)
    out = np.zeros((len(bits), radius + 1), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for k in range(a, b):  # segments of over 64 bits are folded
            out[:, i] = np.bitwise_xor(np.left_shift(out[:, i], np.uint64(1)) ^ np.right_shift(out[:, i], np.uint64(63)), bits[:, k].astype(np.uint64))
    return out.view(np.int64)


def _fingerprint(radius: int):  # noqa: ANN202
    @F.arrow_udf(f"struct<{', '.join(f'{w}:bigint' for w in WORDS)}, codes:array<bigint>>")
    def prints(hosts: pa.Array, guests: pa.Array) -> pa.Array:
        bits = fingerprints(hosts.to_pylist(), guests.to_pylist())
        words = np.packbits(bits, axis=1).reshape(-1).view(np.int64).reshape(-1, len(WORDS))
        codes = segments(bits, radius)
        lists = pa.ListArray.from_arrays(np.arange(len(bits) + 1, dtype=np.int32) * (radius + 1), codes.ravel())
        return pa.StructArray.from_arrays([*(pa.array(np.array(w)) for w in words.T), lists], names=[*WORDS, "codes"])

    return prints


def _similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def linked_texts(
    texts: DataFrame, radius: int, least_similarity: float, together: Column, store: Materialized
) -> DataFrame:
    """``(t1, t2)``: pairs of texts within the radius and alike.

    ``texts`` has ``t`` (its digest), ``h`` and ``g``, and the masks that
    ``together`` compares as ``x.<name>`` with ``y.<name>``.
    """
    masks = [c for c in texts.columns if c not in ("t", "h", "g")]
    printed = store.write(texts.withColumn("p", _fingerprint(radius)("h", "g")).select("t", "h", "g", *masks, "p.*"))
    blocks = printed.select("t", *WORDS, *masks, F.posexplode("codes").alias("seg", "code"))
    x, y = blocks.alias("x"), blocks.alias("y")
    distance = reduce(Column.__add__, [F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in WORDS])
    candidates = (
        x.join(y, (F.col("x.seg") == F.col("y.seg")) & (F.col("x.code") == F.col("y.code")) & together & (distance <= radius))
        .groupBy(F.col("x.t").alias("t1"), F.col("y.t").alias("t2"))
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )
    of = lambda i: printed.select(F.col("t").alias(f"t{i}"), F.col("h").alias(f"h{i}"), F.col("g").alias(f"g{i}"))
    alike = (_similarity(F.col("h1"), F.col("h2")) >= least_similarity) & (_similarity(F.col("g1"), F.col("g2")) >= least_similarity)
    return candidates.join(of(1), "t1").join(of(2), "t2").filter(alike).select("t1", "t2")


# --- records, classes and texts


@dataclass(frozen=True)
class _Masks:
    """Folds as bits of ``words`` 64-bit words, for test and for train."""

    folds: tuple[int, ...]

    @property
    def words(self) -> int:
        return max(1, -(-len(self.folds) // 64))

    @property
    def names(self) -> list[str]:
        return [f"{role}{w}" for role in ("te", "tr") for w in range(self.words)]

    def place(self, fold: Column) -> Column:
        listed = F.array(*map(F.lit, self.folds)) if self.folds else F.array().cast("array<bigint>")
        return (F.array_position(listed.cast("array<bigint>"), fold) - 1).cast("int")

    def has(self, place: Column, word: int) -> Column:
        return F.when(F.floor(place / 64) == word, F.call_function("shiftleft", F.lit(1).cast("bigint"), place % 64)).otherwise(F.lit(0).cast("bigint"))

    def of_rows(self) -> list[Column]:
        """Masks of a group of (place, test) rows."""
        out = []
        for role in ("te", "tr"):
            wanted = F.col("test") if role == "te" else ~F.col("test")
            out += [F.bit_or(F.when(wanted, self.has(F.col("place"), w)).otherwise(F.lit(0).cast("bigint"))).alias(f"{role}{w}") for w in range(self.words)]
        return out

    def merged(self) -> list[Column]:
        return [F.bit_or(c).alias(c) for c in self.names]

    def together(self, left: str, right: str) -> Column:
        """Test on the left, train on the right, in some fold."""
        return reduce(Column.__or__, [F.col(f"{left}te{w}").bitwiseAND(F.col(f"{right}tr{w}")) != 0 for w in range(self.words)])

    def shared(self, left: str, right: str) -> list[Column]:
        return [F.col(f"{left}te{w}").bitwiseAND(F.col(f"{right}tr{w}")).alias(f"m{w}") for w in range(self.words)]

    def holds(self) -> Column:
        """Whether the masks ``m`` hold the fold at ``place``."""
        return reduce(Column.__or__, [F.col(f"m{w}").bitwiseAND(self.has(F.col("place"), w)) != 0 for w in range(self.words)])


def _hash(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text != "", text)


def _digest(*texts: Column) -> Column:
    """Sixteen bytes that stand for texts; lengths keep their borders."""
    parts = [p for t in texts for p in (F.coalesce(F.length(t), F.lit(-1)).cast("string"), F.coalesce(t, F.lit("")))]
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def _members(folds: DataFrame) -> DataFrame:
    """(fold, record, role) with what names the class of the record."""
    role = F.lower(F.trim("role"))
    return (
        folds.select(
            F.trim(F.col("fold_index").cast("string")).try_cast("bigint").alias("fold"),
            F.trim(F.col("row_index").cast("string")).try_cast("bigint").alias("row"),
            (role == "test").alias("test"),
            role.alias("role"),
            known_id(F.col("host_id")).alias("host"),
            known_id(F.col("guest_id")).alias("guest"),
            _hash(F.col("canonical_host_sha256")).alias("hh"),
            _hash(F.col("canonical_guest_sha256")).alias("gh"),
        )
        .filter("role IN ('test', 'train') AND row IS NOT NULL AND fold IS NOT NULL")
        .drop("role")
        .withColumn("class", _digest(F.col("host").cast("string"), F.col("guest").cast("string"), F.col("hh"), F.col("gh")))
    )


def _parent_keys(entries: DataFrame, branch: str, layers: Sequence[str]) -> DataFrame:
    """``(axis, id, keys)``: the usable parent keys of each layer."""
    usable = (
        entries.filter(F.col("branch") == branch)
        .select(
            "axis",
            known_id(F.col("identity_key")).alias("id"),
            "layer",
            F.trim("parent_key").alias("key"),
            F.coalesce("missing", F.lit(False)).alias("gone"),
        )
        .filter("id IS NOT NULL AND NOT gone AND key <> ''")
    )
    keys = [F.collect_set(F.when(F.col("layer") == layer, F.col("key"))) for layer in layers]
    return usable.groupBy("axis", "id").agg(F.array(*keys).alias("keys"))


def layers_of(entries: DataFrame, branch: str) -> list[str]:
    """The identity layers of a branch; a handful by the data model."""
    rows = entries.filter(F.col("branch") == branch).select("layer").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("layer does not look like a layer: over 1000 values")
    return sorted(r[0] for r in rows if r[0] is not None)


@dataclass(frozen=True)
class Overlap:
    """Overlapping classes ``(c1, c2, overlap, m*)``, the test class first,
    and the rows ``(fold, place, class, row, test)`` of these classes."""

    masks: _Masks
    classes: DataFrame
    rows: DataFrame


def overlapping(
    folds: DataFrame,
    entries: DataFrame,
    branch: str = "canonical",
    layers: Sequence[str] | None = None,
    radius: int = RADIUS,
    least_similarity: float = 1.0,
    store: Materialized | None = None,
) -> Overlap:
    store = store or Materialized(folds.sparkSession, "overlap")
    layers = list(layers) if layers is not None else layers_of(entries, branch)
    members = _members(folds)
    masks = _Masks(tuple(block_list(members, "fold")))
    members = members.withColumn("place", masks.place(F.col("fold")))

    classes = members.groupBy("class").agg(*[F.first(c).alias(c) for c in CLASS], *masks.of_rows())
    parents = store.write(_parent_keys(entries, branch, layers))
    of_host = parents.filter("axis = 'host'").select(F.col("id").alias("host"), F.col("keys").alias("hosts"))
    of_guest = parents.filter("axis = 'guest'").select(F.col("id").alias("guest"), F.col("keys").alias("guests"))

    def text(layer: Column, h: Column, g: Column) -> Column:
        return F.struct(layer.cast("int").alias("layer"), h.alias("h"), g.alias("g"))

    hashes = F.when(F.col("hh").isNotNull() & F.col("gh").isNotNull(), F.array(text(F.lit(EXACT), F.col("hh"), F.col("gh"))))
    by_layer = F.transform(
        F.sequence(F.lit(0), F.lit(max(0, len(layers) - 1))),
        lambda i: F.flatten(F.transform(F.get("hosts", i), lambda h: F.transform(F.get("guests", i), lambda g: text(i, h, g)))),
    )
    none = F.array().cast("array<struct<layer:int,h:string,g:string>>")
    every = F.concat(F.coalesce(hashes, none), F.flatten(F.filter(by_layer, lambda a: a.isNotNull())) if layers else none)
    texts = store.write(
        classes.join(of_host, "host", "left")
        .join(of_guest, "guest", "left")
        .select("class", *masks.names, F.explode(every).alias("text"))
        .select("class", *masks.names, "text.*")
        .withColumn("t", _digest(F.col("h"), F.col("g")))
    )
    distinct = texts.groupBy("t").agg(F.first("h").alias("h"), F.first("g").alias("g"), *masks.merged())
    links = store.write(linked_texts(distinct, radius, least_similarity, masks.together("x.", "y."), store))

    left = texts.select(F.col("t").alias("t1"), "layer", F.col("class").alias("c1"), *[F.col(c).alias(f"a{c}") for c in masks.names])
    right = texts.select(F.col("t").alias("t2"), "layer", F.col("class").alias("c2"), *[F.col(c).alias(f"b{c}") for c in masks.names])
    kind = F.when((F.col("layer") == EXACT) & (F.col("t1") == F.col("t2")), "exact").when(F.col("layer") != EXACT, "near")
    found = store.write(
        links.join(left, "t1")
        .join(right, ["t2", "layer"])
        .filter(masks.together("a", "b"))
        .select("c1", "c2", kind.alias("overlap"), *masks.shared("a", "b"))
        .filter("overlap IS NOT NULL")
        # the folds of a pair of classes are the same in every layer
        .groupBy("c1", "c2", *[f"m{w}" for w in range(masks.words)])
        .agg(F.min("overlap").alias("overlap"))
    )
    alive = found.select(F.col("c1").alias("class")).unionByName(found.select(F.col("c2").alias("class"))).distinct()
    rows = store.write(members.select("fold", "place", "class", "row", "test").join(alive, "class", "left_semi").distinct())
    return Overlap(masks, found, rows)


def _pairs(o: Overlap, tests: DataFrame, trains: DataFrame) -> DataFrame:
    """Pairs of rows of overlapping classes, each once."""
    return (
        tests.select(F.col("class").alias("c1"), "fold", "place", F.col("row").alias("r1"))
        .join(o.classes, "c1")
        .filter(o.masks.holds())
        .join(trains.select(F.col("class").alias("c2"), "fold", F.col("row").alias("r2")), ["c2", "fold"])
        .filter("r1 <> r2")
        .groupBy(
            F.col("fold").alias("fold_index"),
            F.least("r1", "r2").alias("row_index_1"),
            F.greatest("r1", "r2").alias("row_index_2"),
        )
        .agg(F.min("overlap").alias("overlap"))
    )


def cross_split_pairs(folds: DataFrame, entries: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """``(fold_index, row_index_1, row_index_2, overlap)``."""
    o = overlapping(folds, entries, **how)
    return _pairs(o, o.rows.filter("test"), o.rows.filter("NOT test"))


def overlap_report(folds: DataFrame, entries: DataFrame, records: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """Overlapping test records per fold, source and kind.

    ``(fold_index, source, overlap, n_records, n_pairs)``; the source is the
    test record's, of its latest row in ``records``, null if it has none.

    Pairs are counted from overlapping classes and how many records each has,
    never listed.  Only records that stand in a fold in two roles or two
    classes, which would be counted twice, are paired one by one.
    """
    o = overlapping(folds, entries, **how)
    source = (
        records.select(F.col("row_index").alias("row"), "source", "loaded_at")
        .groupBy("row")
        .agg(F.max(F.struct("loaded_at", "source"))["source"].alias("source"))
    )
    several = o.rows.groupBy("fold", "row").agg(F.count("*").alias("n")).filter("n > 1").select("fold", "row")
    plain = o.rows.join(several, ["fold", "row"], "left_anti")
    odd = o.rows.join(several, ["fold", "row"], "left_semi")

    tests = plain.filter("test").join(source, "row", "left")
    many = tests.groupBy(F.col("class").alias("c1"), "fold", "place", "source").agg(F.count("*").alias("n1"))
    against = plain.filter("NOT test").groupBy(F.col("class").alias("c2"), "fold").agg(F.count("*").alias("n2"))
    met = (
        many.join(o.classes, "c1").filter(o.masks.holds()).join(against, ["c2", "fold"]).groupBy("c1", "fold", "source", "overlap", "n1").agg(F.sum("n2").alias("n2"))
    )
    counted = met.groupBy("fold", "source", "overlap").agg(F.sum("n1").alias("n_records"), F.sum(F.col("n1") * F.col("n2")).alias("n_pairs"))

    one_odd = _pairs(o, odd.filter("test"), o.rows.filter("NOT test")).unionByName(_pairs(o, tests.drop("source"), odd.filter("NOT test")))
    end = lambda a, b: F.struct(F.col(f"row_index_{a}").alias("row"), F.col(f"row_index_{b}").alias("other"))
    ends = (
        one_odd.groupBy("fold_index", "row_index_1", "row_index_2")
        .agg(F.min("overlap").alias("overlap"))
        .select(F.col("fold_index").alias("fold"), "overlap", F.explode(F.array(end(1, 2), end(2, 1))).alias("end"))
        .select("fold", "overlap", "end.*")
        .join(o.rows.filter("test").select("fold", "row").distinct(), ["fold", "row"], "left_semi")
    )
    # a record that is counted above counts as a record once
    hit = met.select("c1", "fold", "overlap").distinct()
    before = tests.select(F.col("class").alias("c1"), "fold", "row").join(hit, ["c1", "fold"]).select("fold", "overlap", "row")
    fresh = ends.select("fold", "overlap", "row").distinct().join(before, ["fold", "overlap", "row"], "left_anti").withColumn("n_records", F.lit(1))
    added = (
        ends.groupBy("fold", "overlap", "row")
        .agg(F.count("*").alias("n_pairs"))
        .join(fresh, ["fold", "overlap", "row"], "left")
        .join(source, "row", "left")
        .groupBy("fold", "source", "overlap")
        .agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), F.sum("n_pairs").alias("n_pairs"))
    )
    return (
        counted.unionByName(added)
        .groupBy(F.col("fold").alias("fold_index"), "source", "overlap")
        .agg(F.sum("n_records").alias("n_records"), F.sum("n_pairs").alias("n_pairs"))
    )
