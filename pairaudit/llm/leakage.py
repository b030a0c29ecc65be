"""Evaluation texts leaking into training text (problem 7).

Template canonicalisation.  Texts are brought to their canonical form
(``lookalike``), folded in case and cut into words, the longest runs of letters
and digits.  Each word has a template: numbers become ``<number>``, units
``<unit:..>`` with what they measure, and names ``<name>``; ordinary words
stand for themselves.  Which words are ordinary is counted, not listed: those
of the items that stand in at least ``ordinary_share`` of all documents; a name
is any other word.  What a placeholder replaced is the word's slot.

An item of ``n`` words leaks into a document that holds a run of
``L = ceil(n * share)`` of its words, so both sides are cut into windows of
``L`` words for each ``L`` that some item has, and the windows are hash-joined
on their template.  Then the slots are checked:

- ``slots="same"``: each must hold the same word;
- ``slots="consistent"``: names and numbers must be exchanged one for one, so
  that equal ones stay equal and different ones different (adjacent number
  words, as in 6.1, are one number), and units must measure the same.  This
  catches items that were asked again with other parameters.

A template of which under a third are ordinary words says too little: such
windows are joined on their words, so they match only when equal.

Nothing is sampled: every window of every text takes part.  Document windows
are tried against a Bloom filter of the items' windows first (16 bits each).
Items are taken in passes of at most ``ITEMS_WINDOWS`` windows, so the filter
that is sent to the workers has at most 16 MB whatever the items.  A window
begins with one of a power of two of its words; only where that template is
known the lengths above it are tried.  Window hashes are differences of prefix
sums, so a window costs the same whatever its length.

Defined results: null and empty texts and items without a word match nothing;
an item of one word leaks wherever that word stands; repeated rows of an item
or document count once; long texts are read whole; other columns do not take
part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairaudit.llm.lookalike import canonical
from pairaudit.session import Materialized

# Unit symbols (in folded case) by what they measure, those that
# take metric prefixes first, and units written out.  One letter may be two
# units in folded case (metre and molar): they are not told apart.
METRIC = {"m": "m", "å": "m", "g": "g", "s": "time", "mol": "mol", "k": "temperature", "j": "energy", "ev": "energy", "cal": "energy",
          "l": "volume", "pa": "pressure", "bar": "pressure", "hz": "frequency", "v": "voltage", "w": "power"}
PREFIXES = "k c m µ μ u n p d g".split()
PLAIN_UNITS = {"h": "time", "min": "time", "c": "temperature", "atm": "pressure", "ppm": "share", "ppb": "share", "percent": "share",
               "lb": "g", "oz": "g", "ft": "m", "mi": "m"}
WRITTEN = {"metre": "m", "meter": "m", "gram": "g", "second": "time", "minute": "time", "hour": "time", "day": "time", "week": "time",
           "year": "time", "kelvin": "temperature", "degree": "temperature", "litre": "volume", "liter": "volume", "volt": "voltage",
           "watt": "power", "joule": "energy", "calorie": "energy", "mole": "mol", "pascal": "pressure", "foot": "m", "inch": "m", "mile": "m"}
WORDS_THAT_ARE_NO_UNITS = frozenset("pm us ps".split())


def _units() -> dict[str, str]:
    out = {p + u: d for u, d in METRIC.items() for p in ("", *PREFIXES)} | PLAIN_UNITS
    out |= {w + s: d for w, d in WRITTEN.items() for s in ("", "s")}
    return {u: d for u, d in out.items() if u not in WORDS_THAT_ARE_NO_UNITS}


UNITS = _units()
NUMBER, NAME = "<number>", "<name>"
ORDINARY_SHARE = 0.02
_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[\t\n\r -~]*")  # texts that look as they are written
#: Windows of items in one pass: 16 bits of the filter each.
ITEMS_WINDOWS = 1 << 23
#: Words that are hashed at a time in a worker, and remembered.
WORDS_AT_ONCE, REMEMBERED = 400_000, 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    """Words without regard to case or to how they are written."""
    if not text:
        return []
    return _WORD.findall((text if _PLAIN.fullmatch(text) else canonical(text)).casefold())


@dataclass(frozen=True)
class Templates:
    """What each word is in a template, given the ordinary words."""

    ordinary: frozenset[str]

    def of(self, word: str) -> str:
        if word.isnumeric():
            return NUMBER
        if unit := UNITS.get(word):
            return f"<unit:{unit}>"
        return word if word in self.ordinary else NAME


class _Vocabulary(dict):
    """Numbers words as they come; per number its codes and type."""

    def __init__(self, templates: Templates):
        super().__init__()
        self.templates = templates
        self.template_codes: list[int] = []
        self.word_codes: list[int] = []
        self.types: list[int] = []

    def __missing__(self, word: str) -> int:
        t = self.templates.of(word)
        self[word] = number = len(self.types)
        self.template_codes.append(xxhash.xxh64_intdigest(t))
        self.word_codes.append(xxhash.xxh64_intdigest(word, seed=1))
        self.types.append(0 if t == word else 1 if t == NUMBER else 2 if t == NAME else 3)
        return number


def pattern_of(words: Sequence[str], types: Sequence[int]) -> tuple:
    """Which numbers and which names of a window are equal."""
    numbers: dict[tuple, int] = {}
    names: dict[str, int] = {}
    out: list[int] = []
    for kind, run in groupby(zip(words, types, strict=True), key=lambda x: x[1]):
        if kind == 1:
            out.append(numbers.setdefault(tuple(w for w, _ in run), len(numbers)))
        elif kind == 2:
            out.extend(-1 - names.setdefault(w, len(names)) for w, _ in run)
    return tuple(out)


def windows_match(a: Sequence[str], b: Sequence[str], templates: Templates, slots: str) -> bool:
    """The rule that the join and the slot check carry out."""
    ta, tb = [templates.of(w) for w in a], [templates.of(w) for w in b]
    if ta != tb or slots == "same" or 3 * sum(t == w for t, w in zip(ta, a, strict=True)) < len(a):
        return list(a) == list(b)
    kinds = [0 if t == w else 1 if t == NUMBER else 2 if t == NAME else 3 for t, w in zip(ta, a, strict=True)]
    return pattern_of(a, kinds) == pattern_of(b, kinds)


def _prefix(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers, out=sums[1:], dtype=np.uint64)
    return sums


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    """Window codes with their length and well mixed bits."""
    x = codes ^ np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def base_of(length: int) -> int:
    """The power of two that windows of ``length`` words are tried by first."""
    return 1 << (length.bit_length() - 1)


class _Laid:
    """Texts laid end to end, with the prefix sums of their codes."""

    def __init__(self, parts: Sequence[Sequence[str]], vocabulary: _Vocabulary):
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        numbers = np.fromiter((vocabulary[w] for p in parts for w in p), dtype=np.int64, count=int(sizes.sum()))
        ends = np.cumsum(sizes)
        self.owner = np.repeat(np.arange(len(parts)), sizes)
        self.start, self.end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        n = len(numbers)
        powers, self.inverse = np.full(n, _BASE), np.full(n, _INVERSE)
        if n:
            powers[0] = self.inverse[0] = 1
        powers, self.inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(self.inverse, dtype=np.uint64)
        self.types = np.array(vocabulary.types, dtype=np.int8)[numbers]
        self.templates = _prefix(np.array(vocabulary.template_codes, dtype=np.uint64)[numbers], powers)
        self.words = _prefix(np.array(vocabulary.word_codes, dtype=np.uint64)[numbers], powers)
        self.plain = np.r_[0, np.cumsum(self.types == 0)]

    def inside(self, length: int, at: np.ndarray) -> np.ndarray:
        """Positions from which a window does not run over its text's end."""
        return at[at + length <= self.end[at]]

    def base_codes(self, length: int, at: np.ndarray) -> np.ndarray:
        return _mixed((self.templates[at + length] - self.templates[at]) * self.inverse[at], -length)

    def codes(self, length: int, at: np.ndarray) -> np.ndarray:
        """Codes of the templates, of the words where those say too little."""
        of_template = _mixed((self.templates[at + length] - self.templates[at]) * self.inverse[at], length)
        vague = 3 * (self.plain[at + length] - self.plain[at]) < length
        if vague.any():
            of_words = _mixed((self.words[at + length] - self.words[at]) * self.inverse[at], ~length)
            return np.where(vague, of_words, of_template)
        return of_template


@dataclass(frozen=True)
class _Filter:
    """Window lengths, and a Bloom filter of the items' windows."""

    lengths: tuple[int, ...]
    words: np.ndarray

    def hits(self, x: np.ndarray) -> np.ndarray:
        hit = np.arange(len(x))
        for shift in (0, 29):  # two bits each
            slot = (x[hit] >> np.uint64(shift)) & np.uint64(64 * len(self.words) - 1)
            hit = hit[(self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0]
        return hit


WINDOW = "id {kind}, length int, code long, pattern long, slots string"


def _windows_of(texts: Iterable[tuple[object, list[str]]], templates: Templates, known: _Filter, consistent: bool) -> Iterator[tuple]:
    """``(id, length, code, pattern, slots)`` of windows that the filter knows,
    each once per text."""
    vocabulary = _Vocabulary(templates)
    by_base: dict[int, list[int]] = {}
    for length in known.lengths:
        by_base.setdefault(base_of(length), []).append(length)

    def flush(ids: list, parts: list[list[str]]) -> Iterator[tuple]:
        laid = _Laid(parts, vocabulary)
        everywhere = np.arange(len(laid.owner))
        for base, members in by_base.items():
            at = laid.inside(base, everywhere)
            if members != [base]:
                at = at[known.hits(laid.base_codes(base, at))]
            for length in members:
                fits = laid.inside(length, at)
                codes = laid.codes(length, fits)
                seen: set[tuple] = set()
                for k in known.hits(codes).tolist():
                    i = int(fits[k])
                    who = int(laid.owner[i])
                    words = parts[who][i - int(laid.start[i]) :][:length]
                    types = laid.types[i : i + length].tolist()
                    slots = " ".join(w for w, t in zip(words, types, strict=True) if t)
                    if (one := (who, int(codes[k]), slots)) not in seen:
                        seen.add(one)
                        pattern = xxhash.xxh64_intdigest(str(pattern_of(words, types))) if consistent else 0
                        yield ids[who], length, one[1], pattern, slots

    ids: list = []
    parts: list[list[str]] = []
    held = 0
    for key, words in texts:
        if words:
            ids.append(key)
            parts.append(words)
            held += len(words)
        if held >= WORDS_AT_ONCE:
            yield from flush(ids, parts)
            ids, parts, held = [], [], 0
            if len(vocabulary) > REMEMBERED:
                vocabulary = _Vocabulary(templates)
    if parts:
        yield from flush(ids, parts)


def _batches(rows: Iterator[tuple], kind: pa.DataType, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    def batch(held: list[tuple]) -> pa.RecordBatch:
        ids, lengths, codes, patterns, slots = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, kind),
                pa.array(lengths, pa.int32()),
                pa.array(np.array(codes, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(patterns, dtype=np.uint64).view(np.int64)),
                pa.array(slots, pa.string()),
            ],
            names=["id", "length", "code", "pattern", "slots"],
        )

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def run_length(n_words: int, share: float) -> int:
    """The words an item's run needs: the share of them, rounded up."""
    return max(1, int(np.ceil(n_words * share - 1e-9)))


def _keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL AND t <> ''")


def ordinary_words(documents: DataFrame, items: DataFrame, share: float = ORDINARY_SHARE) -> frozenset[str]:
    """Words of ``items(id, t)`` that stand in at least ``share`` of the
    ``documents(id, t)``.

    Counted over whole texts of all documents, combined in the tasks.  At most
    (mean number of different words in a document) / ``share`` words can be
    that frequent, which bounds what reaches the driver.
    """
    cut = F.split(F.lower("t"), r"[^\p{L}\p{N}]+")
    vocabulary = items.select(F.explode(F.array_distinct(cut)).alias("w")).distinct()
    counted = documents.select(F.explode(F.array_distinct(cut)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    least = documents.count() * share
    rows = counted.filter(F.col("n") >= least).join(vocabulary, "w", "left_semi").select("w").collect()
    return frozenset(words_of(" ".join(r[0] for r in rows)))


def _item_windows(items: DataFrame, sent: Broadcast, share: float, consistent: bool) -> DataFrame:
    """All windows of the items, and with null slots the starts that the
    windows of documents are tried by first."""
    schema = WINDOW.format(kind=items.schema["id"].dataType.simpleString())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = sent.value
        everything = np.full(1, ~np.uint64(0))

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                length = run_length(len(words), share)
                yield from _windows_of([(key.as_py(), words)], templates, _Filter((length,), everything), consistent)
                laid = _Laid([words], _Vocabulary(templates))
                starts = np.arange(len(words) - length + 1)
                for code in np.unique(laid.base_codes(base_of(length), starts)).tolist():
                    yield key.as_py(), length, code, 0, None

        for batch in batches:
            yield from _batches(rows(batch), batch.column(0).type)

    return items.mapInArrow(windows, schema)


def _filter_of(windows: DataFrame, n: int) -> _Filter:
    """The filter of at most ``ITEMS_WINDOWS`` windows: at most 2^21 words."""
    size = max(10, int(np.ceil(np.log2(16 * max(1, n)))))
    table = np.zeros(1 << (size - 6), dtype=np.uint64)
    mask = F.lit((1 << size) - 1)
    slots = F.explode(F.array(*[F.shiftrightunsigned("code", s).bitwiseAND(mask) for s in (0, 29)]))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words = windows.select(slots.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    lengths = windows.select("length").distinct().collect()  # as many as items have lengths
    return _Filter(tuple(sorted(r[0] for r in lengths)), table)


def leak_candidates(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    share: float = 0.5,
    slots: str = "same",
    ordinary: Iterable[str] | None = None,
    ordinary_share: float = ORDINARY_SHARE,
    store: Materialized | None = None,
) -> DataFrame:
    """Windows joined on their template, before the slots are checked:
    ``(doc, item, doc_pattern, item_pattern, doc_slots, item_slots)``.

    ``ordinary`` is a lexicon to use instead of the counted words.
    """
    if slots not in ("same", "consistent"):
        raise ValueError(slots)
    consistent = slots == "consistent"
    spark = documents.sparkSession
    store = store or Materialized(spark, "leaks")
    docs, wanted = _keyed_texts(documents, doc_key, doc_text), _keyed_texts(items, item_key, item_text)
    lexicon = frozenset(ordinary) if ordinary is not None else ordinary_words(docs, wanted, ordinary_share)
    sent_templates = spark.sparkContext.broadcast(Templates(lexicon))
    of_items = store.write(_item_windows(wanted, sent_templates, share, consistent).distinct())
    n = of_items.count()
    passes = max(1, -(-n // ITEMS_WINDOWS))
    kind = to_arrow_type(docs.schema["id"].dataType)
    schema = WINDOW.format(kind=docs.schema["id"].dataType.simpleString())

    def one_pass(k: int) -> DataFrame:
        part = of_items.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == k) if passes > 1 else of_items
        sent = spark.sparkContext.broadcast(_filter_of(part, -(-n // passes)))

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def texts() -> Iterator[tuple]:
                for batch in batches:
                    for key, text in zip(batch.column(0), batch.column(1), strict=True):
                        yield key.as_py(), words_of(text.as_py())

            yield from _batches(_windows_of(texts(), sent_templates.value, sent.value, consistent), kind)

        left = docs.mapInArrow(windows, schema).select(F.col("id").alias("doc"), "length", "code", *[F.col(c).alias(f"doc_{c}") for c in ("pattern", "slots")])
        right = part.filter("slots IS NOT NULL").select(F.col("id").alias("item"), "length", "code", *[F.col(c).alias(f"item_{c}") for c in ("pattern", "slots")])
        return left.join(right, ["length", "code"]).drop("length", "code")

    out = one_pass(0)
    for k in range(1, passes):
        out = out.unionByName(one_pass(k))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", slots: str = "same", **how) -> DataFrame:  # noqa: ANN003
    """``(doc_key, item_key)``: documents and the items found in them."""
    joined = leak_candidates(documents, items, doc_key=doc_key, item_key=item_key, slots=slots, **how)
    # equal patterns: names and numbers can be exchanged one for one
    agree = F.col("doc_pattern") == F.col("item_pattern") if slots == "consistent" else F.col("doc_slots") == F.col("item_slots")
    return joined.filter(agree).select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()
