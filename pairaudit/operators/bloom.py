"""A blocked Bloom filter as a DataFrame.

The filter is a table of 64-bit words.  A key sets ``PROBES`` bits of one word;
``bit_or`` merges the keys of a word in each task before the shuffle.  The
number of words follows the number of keys, so the filter is as sharp at any
size.  A filter of at most ``MAX_WORDS`` words is broadcast; that number is the
proof of its size.  A larger one is divided by word: keys and words are hashed
to the same partitions, so each task holds its share of the filter only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 4
KEYS_PER_WORD = 3
#: Words of a filter that is broadcast, and of any (slots are integers).
MAX_WORDS, MOST_WORDS = 1 << 19, 1 << 30


def words_for(n_keys: int) -> int:
    """A power of two with about 64 / KEYS_PER_WORD bits per key."""
    return min(MOST_WORDS, 1 << max(4, math.ceil(math.log2(max(1, n_keys / KEYS_PER_WORD)))))


def _slot(key: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words)).cast("int")


def _bits(key: Column) -> Column:
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        # six bits of the hash choose one bit of the word
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def build(keys: DataFrame, key: str, n_words: int) -> DataFrame:
    """The filter's words: ``(slot, word)``, at most ``n_words`` rows."""
    return (
        keys.filter(F.col(key).isNotNull())
        .groupBy(_slot(F.col(key), n_words).alias("slot"))
        .agg(F.bit_or(_bits(F.col(key))).alias("word"))
    )


def probe(df: DataFrame, key: str, words: DataFrame, n_words: int, out: str = "maybe", max_words: int = MAX_WORDS) -> DataFrame:
    """``df`` with a flag: false is certain, true may be wrong."""
    renamed = words.select(F.col("slot").alias("__slot"), F.col("word").alias("__word"))
    bits = _bits(F.col(key))
    sent = F.broadcast(renamed) if n_words <= max_words else renamed
    return (
        df.join(sent, _slot(F.col(key), n_words) == F.col("__slot"), "left")
        .withColumn(out, F.coalesce(F.col("__word").bitwiseAND(bits) == bits, F.lit(False)))
        .drop("__slot", "__word")
    )
