"""What the operators share: tables, the shared folder, bounded bitmaps, links to components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lists of scratch() that are open; without one, what keep() writes stays until the shared folder goes.
_kept: list[list[str]] = []
#: Rows of texts that are sent to a Python worker at once, and the setting that says so.
ROWS_A_BATCH, _ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Has Spark delete a query's shuffle files as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Its texts may be long: Python workers get ROWS_A_BATCH of them at once, unless the session says otherwise."""
    if spark.conf.get(_ROWS) == "10000":  # Spark's default
        spark.conf.set(_ROWS, str(ROWS_A_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where it is unset and Spark runs on this machine alone, as in tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="corpuslens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


@contextmanager
def scratch() -> Iterator[list[str]]:
    """A list that takes the folders keep() writes meanwhile; release() deletes them."""
    own: list[str] = []
    before, _kept[:] = _kept[:], [own]
    try:
        yield own
    finally:
        _kept[:] = before


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage, and a lost executor costs a read only.

    The shuffles that made it are of no more use: Spark deletes their files when the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for own in _kept:
        own.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that keep() returned. Call it once all that was made from it is kept."""
    delete(df.sparkSession, df.kept_path)


def release(spark: SparkSession, own: list[str]) -> None:
    """Deletes the folders of a scratch() list. Call it once the results made from them are written."""
    while own:
        delete(spark, own.pop())


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a long of its own for every row, the same whenever and however split the table is read.

    It is the row's place in its file, xor a hash of the file's name; places of two files could only meet if
    their hashes agreed in all bits above those that count a file's rows. What is not read straight from
    Parquet files is first kept as such.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation" or plan.relation().fileFormat().toString() != "Parquet":
        df = keep(df, "rows")
    file = df.metadataColumn("_metadata")
    return df.withColumn(name, F.xxhash64(file["file_path"]).bitwiseXOR(file["row_index"]))


def dense(pairs: DataFrame, size: int, fold: Callable[[str], Column]) -> Column:
    """A scalar subquery: pairs(k, v) with 0 <= k < size as an array of `size` values, those of equal k folded, 0 where there is none.

    It is a table of one row, bounded by size, that passes neither through the driver's program nor through the plan's text.
    """
    zeros = pairs.sparkSession.range(size).select(F.col("id").alias("k"), F.lit(0).cast(pairs.schema["v"].dataType).alias("v"))
    every = pairs.select(F.col("k").cast("long"), "v").union(zeros).groupBy("k").agg(fold("v").alias("v"))
    one = every.agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("all"))
    return keep(one.select(F.transform("all", lambda x: x["v"]).alias("dense")), "dense").scalar()


def shift_left(value: Column, n: int | Column) -> Column:
    return F.call_function("shiftleft", value, n.cast("int") if isinstance(n, Column) else F.lit(n))


def one_bit(n: Column) -> Column:
    """A long with bit n set, 0 <= n < 64."""
    return shift_left(F.lit(1).cast("long"), n)


#: Bits of a membership bitmap. It is of fixed size: with more keys it only lets more rows pass.
BITMAP_WORDS = 1 << 16


def bitmap(keys: DataFrame, key: str) -> Column:
    """A one-hash membership bitmap of a long column: a scalar subquery of BITMAP_WORDS longs."""
    h = F.xxhash64(F.col(key))
    return dense(keys.select(F.pmod(h, F.lit(BITMAP_WORDS)).alias("k"), one_bit(F.pmod(F.shiftright(h, 20), F.lit(64))).alias("v")), BITMAP_WORDS, F.bit_or)


def may_hold(words: Column, key: str) -> Column:
    """True for each key that the bitmap was made of, and for few others."""
    h = F.xxhash64(F.col(key))
    word = F.get(words, F.pmod(h, F.lit(BITMAP_WORDS)).cast("int"))
    return F.getbit(word, F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")) == 1


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is two shuffles of thin rows, cut by a
    written table, and rounds grow with the logarithm of the longest path.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # Large star: each larger neighbour of a node is tied to the smallest of its neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(least, "u")
        edges = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = keep(edges, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
