"""Spans of words: tokens with offsets, all spans up to a width, and the best that don't overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a word is, and the most words of a span.
WORD, WIDTH = r"(?U)\w++(?:-\w++)*+|\S", 12


def located(df: DataFrame, key: str, text: str, pattern: str, size: Callable[[Column], Column] = F.length) -> DataFrame:
    """key, k (from 0), value, start of every match of the pattern in df(key, text), whose keys are unique; a running sum of lengths gives the start."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(v.alias("value"), size(v).alias("n")))
    found = F.arrays_zip(hits.alias("hit"), F.transform(F.split(F.col(text), pattern, -1), size).alias("gap"))
    rows = df.select(key, F.posexplode(found).alias("k", "m")).where("m.hit is not null").select(key, "k", "m.hit.value", "m.hit.n", "m.gap")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, "k", "value", (end - F.col("n")).cast("long").alias("start"))


def word_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, k, value, start, end: words and single signs, in characters, end exclusive."""
    return located(df, key, text, WORD).withColumn("end", F.col("start") + F.length("value"))


def spans(df: DataFrame, size: str, *keys: str, width: int = WIDTH) -> DataFrame:
    """keys, start, end (exclusive): every span of up to `width` of a text's `size` words."""
    begins = df.where(F.col(size) > 0).select(*keys, size, F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias("start"))
    ends = F.sequence(F.col("start") + 1, F.least(F.col("start") + width, F.col(size)))
    return begins.select(*keys, "start", F.explode(ends).alias("end"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def apart(found: Column) -> Column:
    """Of array<struct<score, start, end, ...>> the best spans that don't overlap, by start: each goes if it overlaps a better one that stays; ties by start, then end."""
    order = lambda x, y: F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"])
    best = F.array_sort(found, order)
    step = lambda kept, x: F.when(F.exists(kept, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(x)))
    return F.array_sort(F.aggregate(best, F.slice(found, F.lit(1), F.lit(0)), step), lambda x, y: x["start"] - y["start"])
