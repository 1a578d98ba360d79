"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of monotonically_increasing_id() that count the rows of a partition.
_PLACE = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones `draws` draws without replacement hold, for any size of population.

    Inversion over the masses relative to that of the mode. These come from ratios of neighbours, so no
    digits are lost to a large population; masses below 1e-17 of the mode's are left out.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    spread = (draws * (good / (good + bad)) * (bad / (good + bad))) ** 0.5
    reach = int(10 * spread) + 60
    k = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    up = np.cumprod((good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1)))
    k = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    down = np.cumprod(k / (good - k + 1) * ((bad - draws + k) / (draws - k + 1)))
    mass = np.concatenate([down[::-1], [1.0], up]).cumsum()
    return mode - len(down) + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A communication matrix with these row and column sums, as a uniform permutation of all rows would give it."""
    rng, left = np.random.default_rng(seed), list(columns)
    out = []
    for n in rows:
        rest, line = sum(left), []
        for k, room in enumerate(left):
            rest -= room
            x = hypergeometric(rng, room, rest, n)
            n -= x
            left[k] -= x
            line.append(x)
        out.append(line)
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 17) -> DataFrame:
    """Every row of df in one of `shards` shards: doc_id, size, text_crc32, shard, slot.

    Shard sizes differ by one row at most and slots run from 0 without gaps; every assignment is equally
    likely, so equal texts spread like any rows. Each input partition is permuted where it is; the exact
    counts that go from it to each shard are drawn on the driver (one line of `shards` numbers a partition);
    the rows are exchanged by these counts, in ranges of a new random order within their shard, so that no
    task holds a shard.
    Null text: size 1, crc of the empty text. Equal rows are rows of their own. No rows: no rows. Other
    columns are left out.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = common.numbered(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    base = common.keep(rows.sortWithinPartitions(F.xxhash64("row", F.lit(seed)), "row").withColumn("place", F.monotonically_increasing_id()), "shard-rows")
    block, at = F.shiftright("place", _PLACE), F.col("place").bitwiseAND(F.lit((1 << _PLACE) - 1))
    counts = base.groupBy(block.alias("block")).count().orderBy("block").collect()
    drawn = matrix([r["count"] for r in counts], even(sum(r["count"] for r in counts), shards), seed)
    lines = [(r.block, np.cumsum(line).tolist()) for r, line in zip(counts, drawn)]
    # One row an input partition, of `shards` numbers.
    ways = spark.createDataFrame(lines, "block long, ends array<long>")
    dealt = base.withColumn("block", block).join(F.broadcast(ways), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e <= at)))
    order = ("shard", "again", "row")
    dealt = dealt.select("doc_id", "size", "text_crc32", "row", "shard", F.xxhash64("row", F.lit(seed + 2)).alias("again"))
    laid = common.keep(dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("row", "again").withColumn("place", F.monotonically_increasing_id()), "shard-laid")
    # A range holds a stretch of each of its shards: its first place there, and the shard's rows before it.
    here = laid.groupBy("shard", F.shiftright("place", _PLACE).alias("range")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = here.select("shard", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))  # one row a shard and range
    out = laid.withColumn("range", F.shiftright("place", _PLACE)).join(F.broadcast(starts), ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") + F.col("shift")).alias("slot"))
