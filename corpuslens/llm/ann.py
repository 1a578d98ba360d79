"""Approximate nearest neighbours by adaptive dimension scan: rotated vectors in column blocks, and a test on partial distances that abandons candidates early."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The index is fitted on at most so many vectors, those of the smallest hashes.
SAMPLE = 16_384
#: At most so many lists; a query probes this share of them, but LEAST_PROBES at least.
MOST_LISTS, PROBE_SHARE, LEAST_PROBES = 1024, 0.65, 16
#: Dimensions of a column block, the strictness of the test, vectors of a block of a list, queries at once.
COLUMNS, STRICT, BLOCK, BATCH = 16, 2.1, 4096, 64


def fit(sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, centroids of the rotated sample): a random orthogonal matrix and Lloyd's iterations."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
    points = sample @ rotation
    centers = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(rounds):
        own = nearest(points, centers, 1)[:, 0]
        sums, counts = np.zeros_like(centers), np.bincount(own, minlength=lists)
        np.add.at(sums, own, points)
        some = counts > 0
        centers = centers.copy()
        centers[some] = sums[some] / counts[some, None]
    return rotation, centers


def nearest(points: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """For each point the places of its k nearest centers."""
    out = []
    for at in range(0, len(points), 1024):
        far = (centers**2).sum(1) - 2 * points[at : at + 1024] @ centers.T
        out.append(np.argpartition(far, min(k, len(centers) - 1), 1)[:, :k] if k < len(centers) else np.tile(np.arange(len(centers)), (len(far), 1)))
    return np.concatenate(out)


def scan(queries: np.ndarray, base: np.ndarray, k: int, strict: float = STRICT) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the pairs that no test abandoned, all dimensions of which were then read.

    queries and base are rotated, so the first d of D dimensions are a random projection: a candidate is
    abandoned if its partial distance says, against a bound from k candidates read to the end, that the
    whole distance is beyond the bound: partial > (d / D) (1 + strict / sqrt(d))^2 bound.
    """
    dims = queries.shape[1]
    d = min(COLUMNS, dims)
    a, b = queries[:, :d], base[:, :d]
    part = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)
    first = min(4 * k, len(base))
    lead = np.argpartition(part, first - 1, 1)[:, :first]
    full = ((queries[:, None, :] - base[lead]) ** 2).sum(2)
    bound = np.partition(full, min(k, first) - 1, 1)[:, min(k, first) - 1] * (1 + 1e-6)
    q, c = np.nonzero(part <= (bound * (d / dims) * (1 + strict / math.sqrt(d)) ** 2)[:, None]) if d < dims else np.nonzero(part <= bound[:, None] + 1e-6)
    # The leading candidates stay in any case: their distances are known.
    lead_q = np.repeat(np.arange(len(queries)), first)
    have = np.zeros(part.shape, bool)
    have[q, c] = True
    have[lead_q, lead.ravel()] = True
    q, c = np.nonzero(have)
    far = part[q, c]
    while d < dims:
        to = min(d + COLUMNS, dims)
        far = far + ((queries[q, d:to] - base[c, d:to]) ** 2).sum(1)
        d = to
        keep = far <= bound[q] * (1 + 1e-6) if d == dims else far <= bound[q] * (d / dims) * (1 + strict / math.sqrt(d)) ** 2
        q, c, far = q[keep], c[keep], far[keep]
    return q, c


def _search(batches: Iterator[pa.RecordBatch], dims: int, k: int, strict: float) -> Iterator[pa.RecordBatch]:
    """Nearest pairs (query, rep, score) of rows (list, block, kind, rep, rotated, vector), sorted by them: in each block of a list its vectors come first, then the queries that probe it."""
    own, reps, turned, vectors = None, [], [], []
    base = None
    waiting: list[tuple] = []
    out: list[tuple[int, int, float]] = []

    def answer() -> None:
        nonlocal base
        if waiting and reps:
            if base is None:
                base = tuple(np.frombuffer(b"".join(x), kind).reshape(-1, dims) for x, kind in ((turned, "<f4"), (vectors, "<f8")))
            asked = np.frombuffer(b"".join(w[1] for w in waiting), "<f4").reshape(-1, dims)
            exact = np.frombuffer(b"".join(w[2] for w in waiting), "<f8").reshape(-1, dims)
            q, c = scan(asked, base[0], k, strict)
            far = np.sqrt(((exact[q] - base[1][c]) ** 2).sum(1))
            ids = np.array(reps, np.int64)[c]
            order = np.lexsort((ids, far, q))
            q, far, ids = q[order], far[order], ids[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, "left")
            for j, i, f in zip(q[place < k].tolist(), ids[place < k].tolist(), far[place < k].tolist()):
                out.append((waiting[j][0], i, f))
        waiting.clear()

    def batch_out() -> pa.RecordBatch:
        rows = list(zip(*out)) or [[], [], []]
        done = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], ["query", "rep", "score"])
        out.clear()
        return done

    for batch in batches:
        for at, block, kind, rep, rotated, vector in zip(*(batch.column(j).to_pylist() for j in range(6))):
            if (at, block) != own:
                answer()
                own, base = (at, block), None
                reps, turned, vectors = [], [], []
            if kind == 0:
                reps.append(rep)
                turned.append(rotated)
                vectors.append(vector)
            else:
                waiting.append((rep, rotated, vector))
                if len(waiting) >= BATCH:
                    answer()
                    if len(out) > 50_000:
                        yield batch_out()
    answer()
    yield batch_out()


def neighbours(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", probe_share: float = PROBE_SHARE, strict: float = STRICT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision) of the k nearest found for each row whose id is divisible by `every`.

    Rows without an id or vector, and zero vectors or such with null or non-finite components, take no part;
    nor do vectors of another length than most of the sample. Equal vectors are one in the index, with their
    k + 1 smallest ids (no other can be among the k nearest); a query's own row is no candidate, other rows
    with its id are. Ties go to the smaller id. Fewer candidates: all of them. No vectors: no rows.
    """
    spark = df.sparkSession
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    drawn = [r.v for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        return spark.createDataFrame([], schema)
    lengths = [len(x) for x in drawn]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n))
    sample = np.unique(np.array([x for x in drawn if len(x) == dims]), axis=0)
    rows = rows.where(F.size("v") == dims)
    total = rows.count()
    lists = max(1, min(MOST_LISTS, round(math.sqrt(total)), len(sample) // 4))
    probes = min(lists, max(LEAST_PROBES, math.ceil(lists * probe_share)))
    model = spark.sparkContext.broadcast(fit(sample, lists))  # MOST_LISTS vectors and one square matrix
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = common.keep(rows.withColumn("at", first).where(F.col("at") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "ids", "v"), "vectors")
    asks = common.keep(rows.where(F.col("id") % every == 0).join(classes.select("rep", "v"), "v").select(F.col("id").alias("query_id"), "rep"), "queries")

    def place(many: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rotation, centers = model.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = np.array(batch.column(1).to_pylist())
                turned = vectors @ rotation
                where = nearest(turned, centers, probes if many else 1)
                n = where.shape[1]
                pick = np.repeat(np.arange(len(vectors)), n)
                rep = batch.column(0).take(pa.array(pick))
                raw = [t.tobytes() for t in turned.astype("<f4")], [t.tobytes() for t in vectors.astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array(where.ravel(), pa.int32()), rep, *(pa.array([r[j] for j in pick.tolist()], pa.binary()) for r in raw)], ["list", "rep", "rotated", "vector"])

        return run

    shape = "list int, rep long, rotated binary, vector binary"
    index = common.keep(classes.select("rep", "v").mapInArrow(place(False), shape), "index")
    blocks = index.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)  # one row a list, MOST_LISTS at most
    base = index.join(blocks, "list").select("list", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "rep", "rotated", "vector")
    probing = classes.join(asks.select("rep").distinct(), "rep", "left_semi").select("rep", "v").mapInArrow(place(True), shape)
    probing = probing.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "rep", "rotated", "vector")
    met = base.union(probing).repartition("list", "block").sortWithinPartitions("list", "block", "kind", "rep").mapInArrow(lambda it: _search(it, dims, k + 1, strict), "query long, rep long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
    met = met.withColumn("at", best).where(F.col("at") <= k + 1).drop("at").join(classes.select("rep", "ids"), "rep")
    found = met.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("id")))))), 1, k + 1).alias("near"))
    # At most (k + 1)^2 ids a query gather above; of its own id one is dropped.
    mine = F.array_position(F.transform("near", lambda x: x["id"]), F.col("query_id")).cast("int")
    rest = F.filter("near", lambda x, j: j + 1 != mine)
    out = asks.join(found, asks.rep == found["query"]).select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
