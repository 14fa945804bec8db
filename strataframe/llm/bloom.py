"""Blocked Bloom filters as tables, sized from the number of keys [DataFrame functions only].

A filter takes BITS_A_KEY bits for each key, so it passes about one in a hundred other keys whatever the number of keys.
It is broadcast up to MOST_BLOCKS blocks of 256 bits; a list too long for that is joined without a filter, which
gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 12
#: The largest filter that is broadcast: as many rows of 48 bytes, about 25 MB, for eleven million keys.
MOST_BLOCKS = 1 << 19


def blocks_for(keys: int) -> int:
    """Blocks for so many keys: a power of two."""
    return 1 << max(0, (keys * BITS_A_KEY // 256)).bit_length()


def _masks() -> list[Column]:
    """Two bits in each of the four words of a key's block."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h2, {12 * i}) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(_h2, {12 * i + 6}) & 63 as int))") for i in range(4)]


def hashed(df: DataFrame, key: str, blocks: int) -> DataFrame:
    df = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("_h2", F.xxhash64(F.lit(1), key))
    return df.withColumns({f"_m{i}": m for i, m in enumerate(_masks())}).drop("_h2")


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``_block, _w0 .. _w3``: blocks of 256 bits; at most ``blocks`` rows, however many keys there are."""
    return hashed(keys.select(key), key, blocks).groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(4)])


def probed(df: DataFrame, key: str, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """``df`` with ``_maybe``: whether the filter may hold the key; never false for one that it holds."""
    probe = hashed(df, key, blocks).join(F.broadcast(filter_rows), "_block", "left")  # at most MOST_BLOCKS rows
    passes = F.lit(True)
    for i in range(4):
        passes = passes & F.coalesce(F.col(f"_w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"), F.lit(False))
    return probe.withColumn("_maybe", passes).select(*df.columns, "_maybe")


def sifted(df: DataFrame, keys: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """``df`` with ``_maybe``, false only where ``keys`` does not hold the key. ``keys`` is counted unless ``blocks`` is
    given; beyond MOST_BLOCKS there is no filter and every row passes."""
    blocks = blocks or blocks_for(keys.count())
    if blocks > MOST_BLOCKS:
        return df.withColumn("_maybe", F.lit(True))
    return probed(df, key, bloom(keys, key, blocks), blocks)


def semi_join(df: DataFrame, keys: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``, exactly; those that the filter rules out aren't shuffled."""
    return sifted(df, keys, key, blocks).filter("_maybe").drop("_maybe").join(keys.select(key), key, "left_semi")
