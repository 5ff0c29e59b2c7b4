"""A blocked Bloom filter as a table: DataFrame operations only.

Each key belongs to one block and sets one bit in each of the block's eight words. A probe joins the block and tests
the words; what passes is a superset of the listed rows, so an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a block; a key sets one bit in each.
WORDS = 8
BITS_PER_KEY = 16
#: Blocks of a filter that is sent to every executor, at most: 4 MB of bits.
MOST_BLOCKS = 1 << 16


def blocks_for(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))


def _bit(h2: Column, i: int) -> Column:
    """Six bits of h2 choose the bit of word i."""
    return F.shiftrightunsigned(h2, 6 * i).bitwiseAND(F.lit(63)).cast("int")


def _hashes(key: str, n_blocks: int) -> dict[str, Column]:
    return {"block": F.pmod(F.xxhash64(key), F.lit(n_blocks)), "h2": F.xxhash64(F.lit("bits"), key)}


def filter_table(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w7)."""
    one = F.lit(1).cast("bigint")
    return (
        keys.select(*(c.alias(name) for name, c in _hashes(key, n_blocks).items()))
        .groupBy("block")
        .agg(*(F.bit_or(F.call_function("shiftleft", one, _bit(F.col("h2"), i))).alias(f"w{i}") for i in range(WORDS)))
    )


def probe(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose key may be in the filter. Spark picks the join by the size of blocks."""
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.call_function("shiftrightunsigned", F.col(f"w{i}"), _bit(F.col("h2"), i)).bitwiseAND(F.lit(1)) == 1)
    return rows.withColumns(_hashes(key, n_blocks)).join(blocks, "block").where(hit).drop("block", "h2", *(f"w{i}" for i in range(WORDS)))


def likely(rows: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """rows without most of those whose key is not among keys, to spare the shuffle of an exact join.

    The filter has MOST_BLOCKS blocks at most, so that it can be sent everywhere; with more keys than it is made
    for it lets more rows pass, and the exact join behind it still decides.
    """
    n_blocks = min(blocks_for(n_keys), MOST_BLOCKS)
    return probe(rows, key, F.broadcast(filter_table(keys, key, n_blocks)), n_blocks)
