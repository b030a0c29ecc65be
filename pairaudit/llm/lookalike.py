"""Visually identical text with different characters (problem 8).

Each character has a quick-check property: *stable* characters stand for
themselves and neither combine backwards nor change; all others are unstable.
Text is scanned for unstable segments only; a segment is widened by the stable
starter before it, because a mark may combine with that, brought to the
canonical form, and spliced back between the untouched stretches.  Most texts
have no unstable segment and pass through as they are.

The canonical form, under which texts that look alike are equal,
- drops what cannot be seen: format characters, variation selectors, fillers,
  controls other than blanks and line breaks;
- turns every blank (tab, no-break, figure, thin, ideographic ...) into one
  space, and every kind of line break into one line feed;
- takes width and mathematical fonts out of letters and digits, opens ligatures
  and digraphs, and makes the hyphen and the no-break hyphen a hyphen-minus;
- folds letters that look like Latin ones (the tables below), each after
  canonical decomposition, so accents stay;
- in words that hold a Latin letter, folds the further letters that the Unicode
  confusables data (UTS 39) call confusable with one of the same case: alone
  such letters (a Greek alpha, a Cyrillic te) are letters of their own;
- composes canonically.
It keeps capitals, accents, raised and lowered digits, and the number of
blanks.  Null stays null and empty stays empty; texts of any length are
normalised whole.

The canonical form is a key.  ``readable`` is the text to train on: it differs
in that letters of other scripts are folded in words with a Latin letter only,
so a word of one script stays in it, and joiners stay between emoji and in
scripts that join.

Pairs: repeated rows count once; texts that show nothing at all look the same
as each other; empty tables give no rows; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.session import Materialized

# Letters of other scripts that look like a Latin letter.
CYRILLIC_CAPITALS = dict(zip("АВЕЅІЈКМНОРСТУХҮҺԌԚԜ", "ABESIJKMHOPCTYXYhGQW", strict=True))
CYRILLIC_SMALL = dict(zip("аеѕіјорсухһԁԛԝѵӏ", "aesijopcyxhdqwvl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj", strict=True))
HYPHENS = {"‐": "-", "‑": "-"}
LOOKALIKE = CYRILLIC_CAPITALS | CYRILLIC_SMALL | GREEK | HYPHENS
del LOOKALIKE["Һ"]

BREAKS = frozenset("\n\r\v\f\x85\u2028\u2029")
#: Format characters that are seen: Arabic, Syriac and Kaithi number signs.
SEEN = frozenset("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u08e2\U000110bd\U000110cd")
#: Not of category Cf, yet never seen.
FILLERS = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0")


def _opened(c: str) -> bool:
    """Compatibility characters that look like their parts."""
    o = ord(c)
    return (
        o in (0xB5, 0x132, 0x133, 0x2024, 0x2025, 0x2026)
        or 0x1C4 <= o <= 0x1CC
        or 0x1F1 <= o <= 0x1F3
        or 0x2160 <= o <= 0x217F
        or 0xFB00 <= o <= 0xFB06
        or 0xFB13 <= o <= 0xFB17
    )


@cache
def _plain(c: str) -> str:
    """What one character becomes before composition."""
    if c in BREAKS:
        return "\n"
    category = unicodedata.category(c)
    o = ord(c)
    if c == "\t" or category == "Zs" or o == 0x2800:
        return " "
    if c in FILLERS or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return ""
    if category in ("Cf", "Cc") and c not in SEEN:
        return ""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind in ("<wide>", "<narrow>", "<noBreak>", "<font>") or (kind.startswith("<") and _opened(c)):
        return "".join(_plain(chr(int(x, 16))) for x in rest.split())
    return "".join(LOOKALIKE.get(x, x) for x in unicodedata.normalize("NFD", c))


@cache
def _unfolded(c: str) -> str:
    """As ``_plain``, but letters keep their script."""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind in ("<wide>", "<narrow>", "<noBreak>", "<font>") or (kind.startswith("<") and _opened(c)):
        return "".join(_unfolded(chr(int(x, 16))) for x in rest.split())
    return unicodedata.normalize("NFD", c) if c.isalpha() else _plain(c)


@cache
def _stable(c: str) -> bool:
    """Quick check: stands for itself and never combines backwards."""
    if unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) <= 0x11FF:
        return False
    return unicodedata.normalize("NFC", _plain(c)) == c


def _form(segment: str) -> str:
    return unicodedata.normalize("NFC", "".join(map(_plain, segment.replace("\r\n", "\n"))))


def _joins(c: str) -> bool:
    """Characters beside which a joiner is seen."""
    return unicodedata.category(c) in ("So", "Sk", "Lo", "Mn", "Mc") or 0xFE00 <= ord(c) <= 0xFE0F


def _readable_form(segment: str) -> str:
    s = segment.replace("\r\n", "\n")
    out = []
    for i, c in enumerate(s):
        joiner = c in "\u200c\u200d" and 0 < i < len(s) - 1 and _joins(s[i - 1]) and _joins(s[i + 1])
        selector = c == "\ufe0f" and i and unicodedata.category(s[i - 1]) in ("So", "Sk")
        out.append(c if joiner or selector else _unfolded(c))
    return unicodedata.normalize("NFC", "".join(out))


def confusables(spark: SparkSession) -> Confusables:
    """Letters that the Unicode confusables data (UTS 39) hold confusable with
    a Latin letter of their case, and that letter.

    The data are those of the ICU library that Spark brings along (ICU 77, the
    data of Unicode 16, with Spark 4.1); a Spark without it gives no letters.
    Letters of the Latin script are other letters to a reader, but for the two
    that are another shape of one.
    """
    icu = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker", None)
    if not hasattr(icu, "Builder"):
        return NONE
    checker = icu.Builder().build()
    skeletons = lambda chars: checker.getSkeleton("\n".join(chars)).split("\n")
    latin = [chr(c) for c in range(128) if chr(c).isalpha()]
    of: dict[str, list[str]] = {}
    for letter, skeleton in zip(latin, skeletons(latin), strict=True):
        of.setdefault(skeleton, []).append(letter)
    han = lambda c: 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD800 or 0x17000 <= c < 0x19000 or c >= 0x20000
    others = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and not han(c)]
    out = {}
    for c, skeleton in zip(others, skeletons(others), strict=True):
        if unicodedata.name(c, "").startswith("LATIN") and c not in "\u0251\u0261":
            continue
        kind = unicodedata.category(c)
        fit = [x for x in of.get(skeleton, ()) if (kind == "Lo") or (x.isupper() == (kind == "Lu"))]
        if fit and unicodedata.normalize("NFD", c) == c:
            out[c] = fit[-1]
    return Confusables(out, [c for c in others if len(unicodedata.normalize("NFD", c)) > 1])


class Confusables(dict):
    """Letters and the Latin letters they are folded to in words that hold a
    Latin letter."""

    def __init__(self, table: Mapping[str, str], letters: Sequence[str] = ()):
        super().__init__(table)
        composed = [c for c in letters if unicodedata.normalize("NFD", c)[0] in table]
        self.letters = frozenset(table) | frozenset(composed)

    def __reduce__(self) -> tuple:
        return Confusables, (dict(self), tuple(self.letters - frozenset(self)))

    def folded(self, text: str, present: Iterable[str]) -> str:
        """``text`` with its words folded; only those with a letter of
        ``present`` are looked at."""
        spots: list[int] = []
        for c in present:
            i = text.find(c)
            while i >= 0:
                spots.append(i)
                i = text.find(c, i + 1)
        parts, done = [], 0
        for i in sorted(spots):
            if i < done:
                continue
            begin, end = i, i + 1
            while begin > done and _in_word(text[begin - 1]):
                begin -= 1
            while end < len(text) and _in_word(text[end]):
                end += 1
            parts += [text[done:begin], self.word(text[begin:end])]
            done = end
        parts.append(text[done:])
        return "".join(parts)

    def word(self, word: str) -> str:
        apart = unicodedata.normalize("NFD", word)
        if not _LATIN.search(apart):
            return word
        return unicodedata.normalize("NFC", "".join(self.get(c, c) for c in apart))


_LATIN = re.compile("[A-Za-z]")


def _in_word(c: str) -> bool:
    """Words are letters and their marks."""
    return c.isalpha() or "\u0300" <= c <= "\u036f"


NONE = Confusables({})


#: Stretches outside printable ASCII and line feeds.
_DOUBTFUL = re.compile(r"(?:\r\n?|[^\x20-\x7e\n])+")
#: Characters found stable so far.
_KNOWN_STABLE = {chr(c) for c in range(0x20, 0x7F)} | {"\n"}


def _doubtful(c: str) -> bool:
    return not (" " <= c <= "~" or c == "\n")


def _segments(text: str, unstable: set[str]) -> Iterator[tuple[int, int]]:
    """Doubtful stretches that hold an unstable character."""
    if len(unstable) > 4:
        for found in _DOUBTFUL.finditer(text):
            if not unstable.isdisjoint(found.group()):
                yield found.span()
        return
    at: list[int] = []
    for c in unstable:  # few of them: searched one by one
        i = text.find(c)
        while i >= 0:
            at.append(i)
            i = text.find(c, i + 1)
    done, n = 0, len(text)
    for i in sorted(at):
        if i < done:
            continue
        begin, end = i, i + 1
        while begin > done and _doubtful(text[begin - 1]):
            begin -= 1
        while end < n and (_doubtful(text[end]) or (text[end] == "\n" and text[end - 1] == "\r")):
            end += 1
        yield begin, end
        done = end


def _spliced(text: str, unstable: set[str], form: Callable[[str], str]) -> str:
    parts: list[str] = []
    done = 0
    for begin, end in _segments(text, unstable):
        begin = max(done, begin - 1)  # the starter that a mark may join
        parts.append(text[done:begin])
        parts.append(form(text[begin:end]))
        done = end
    parts.append(text[done:])
    return "".join(parts)


def _unstable(characters: set[str]) -> set[str]:
    doubtful = characters - _KNOWN_STABLE
    unstable = {c for c in doubtful if not _stable(c)}
    _KNOWN_STABLE.update(doubtful - unstable)
    return unstable


def _normal(text: str, wide: Confusables, form: Callable[[str], str]) -> str:
    characters = set(text)
    if unstable := _unstable(characters):
        text = _spliced(text, unstable, form)
        characters = set(text) if wide else characters
    present = wide.letters & characters
    return wide.folded(text, present) if present else text


def canonical(text: str, wide: Confusables = NONE) -> str:
    """``text`` in the one form under which texts that look alike are equal.

    ``wide`` are the ``confusables``."""
    return _normal(text, wide, _form)


def readable(text: str, wide: Confusables = NONE) -> str:
    """``text`` to train on: one form, with words of other scripts kept.

    ``wide`` are the ``confusables`` with ``LOOKALIKE``."""
    return _normal(text, wide, _readable_form)


def with_lookalikes(wide: Confusables) -> Confusables:
    return Confusables({**wide, **LOOKALIKE}, tuple(wide.letters))


def _looks_as_written(text: str | None) -> bool:
    return text is None or (text.isascii() and text.isprintable())


def canonical_of(series: pd.Series, wide: Confusables = NONE) -> pd.Series:
    return series.map(lambda t: t if _looks_as_written(t) else canonical(t, wide))


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, skeleton)``: each text as one should train on it, and its
    canonical form, under which it equals all texts that look the same."""
    wide = confusables(df.sparkSession)
    letters = with_lookalikes(wide)

    @F.pandas_udf(f"`{text}` string, skeleton string")
    def forms(series: pd.Series) -> pd.DataFrame:
        kept = series.map(lambda t: t if _looks_as_written(t) else readable(t, letters))
        return pd.DataFrame({text: kept, "skeleton": canonical_of(series, wide)})

    return df.select(key, forms(F.col(text)).alias("f")).select(key, "f.*")


def _keyed(df: DataFrame, key: str, text: str, store: Materialized | None) -> DataFrame:
    """``(id, look, raw, h)``: digests of the look and of the characters."""

    wide = confusables(df.sparkSession)

    @F.pandas_udf("binary")
    def look(series: pd.Series) -> pd.Series:
        return canonical_of(series, wide).map(lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest())

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL AND t <> ''")
    digests = rows.select("id", look("t").alias("look"), F.unhex(F.sha2("t", 256)).alias("raw"), F.xxhash64("t").alias("h"))
    # written once, so that the texts are read and normalised once
    return (store or Materialized(df.sparkSession, "looks")).write(digests)


def _mixed(keyed: DataFrame) -> DataFrame:
    """Looks that occur in more than one spelling."""
    return keyed.groupBy("look").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("look")


def lookalike_pairs(df: DataFrame, key: str, text: str, store: Materialized | None = None) -> DataFrame:
    """``(<key>_1, <key>_2)``: texts that look the same and are not equal.

    Only digests are shuffled.  Looks of a single spelling, be it one text or
    a third of all, leave before the join.  Spellings are paired first, and
    texts only by pairs of spellings, so copies of one spelling never meet.
    """
    keyed = _keyed(df, key, text, store)
    rows = keyed.join(_mixed(keyed), "look", "left_semi").select("id", "look", "raw").distinct()
    spellings = rows.select("look", "raw").distinct()
    two = spellings.join(spellings.select("look", F.col("raw").alias("raw2")), "look").filter("raw < raw2").drop("look")
    return (
        two.join(rows.select("raw", F.col("id").alias("a")), "raw")
        .join(rows.select(F.col("raw").alias("raw2"), F.col("id").alias("b")), "raw2")
        .filter("a <> b")
        .select(F.least("a", "b").alias(f"{key}_1"), F.greatest("a", "b").alias(f"{key}_2"))
        .distinct()
    )


def lookalike_classes(df: DataFrame, key: str, text: str, store: Materialized | None = None) -> DataFrame:
    """``(key, class_id, n_texts, n_spellings)`` of every text that has a
    look-alike; the class is named by its smallest id."""
    keyed = _keyed(df, key, text, store)
    rows = keyed.join(_mixed(keyed), "look", "left_semi").select("id", "look", "raw").distinct()
    sizes = rows.groupBy("look", "raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = sizes.groupBy("look").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("n_texts"), F.count("*").alias("n_spellings")
    )
    return rows.join(classes, "look").select(F.col("id").alias(key), "class_id", "n_texts", "n_spellings")
