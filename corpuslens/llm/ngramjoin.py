"""N-gram Jaccard join: globally ordered shingle sets in a trie, traversed with shared partial overlaps and pruned by remaining lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokencount import slices

#: Counters of the rarity order, in so many slices; any number of them gives an exact join.
COUNTERS, PARTS = 1 << 20, 64
#: Bytes of text hashed at once; sets of one trie.
SLICE, TRIE = 1 << 20, 512

_U = np.uint64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two rounds of xor-shift and odd multiplication)."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte's place, bounds of each text's words) of texts set one after the other, a blank between.

    Words are runs of bytes that are no white space ([\\t-\\r ]), A-Z lower-cased. The hash is a polynomial of
    the bytes, mixed with their number.
    """
    raw = np.frombuffer(b" ".join((t or b"").translate(_FOLD) for t in texts) + b" ", np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    bounds = np.searchsorted(begin, np.cumsum([0] + [len(t or b"") + 1 for t in texts]))
    if not len(begin):
        return np.empty(0, _U), begin, bounds
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.full(int(size.max()), 0x9E3779B97F4A7C15, _U)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat((raw[inside].astype(_U) + _U(1)) * powers[place], first) + size.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), begin, bounds


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct n-word shingles (mixed sums of word hashes by place); all words as one if there are fewer than n."""
    word, _, bounds = word_hashes(texts)
    odd = mix(np.arange(1, n + 1, dtype=_U)) | _U(1)
    gram = np.zeros(max(0, len(word) - n + 1), _U)
    for k in range(n):
        gram += word[k : len(word) - n + 1 + k] * odd[k] if len(gram) else _U(0)
    gram = mix(gram)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([(word[a:b] * odd[: b - a]).sum() + _U(b - a)], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def signature(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum() + _U(len(s))], _U)).view(np.int64)[0])


def ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles as keys of one global order: frequent ones first, then by hash."""
    return np.sort((_U(255) - classes[(s >> _U(44)).astype(np.int64)].astype(_U)) << _U(56) | s & _U((1 << 56) - 1))


def need(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of these sizes that links them."""
    return -(-percent * (a + b) // (100 + percent))


def trie_join(x: np.ndarray, rows: list[tuple[int, bytes]], percent: int) -> list[int]:
    """The ids of rows (id, keys as big-endian bytes) whose sets link with x.

    The rows, sorted by their bytes, are a trie: a node is a stretch of rows and the tokens that they share
    from its depth on. The overlap with x is counted once for all rows below a node, and a subtree is left
    as soon as the tokens that remain, of x and of its longest row, can't reach the overlap its shortest row needs.
    """
    rows = sorted(rows, key=lambda r: r[1])
    keys = [np.frombuffer(r[1], ">u8").astype(_U) for r in rows]
    size = np.array([len(k) for k in keys])
    n, out = len(x), []
    stack = [(0, len(rows), 0, 0)] if rows else []
    while stack:
        low, high, depth, overlap = stack.pop()
        a, b = keys[low], keys[high - 1]
        m = min(len(a), len(b))
        apart = np.flatnonzero(a[depth:m] != b[depth:m]) if high - low > 1 else ()
        to = depth + int(apart[0]) if len(apart) else m
        rest = n
        if to > depth:
            part = a[depth:to]
            at = np.searchsorted(x, part)
            overlap += int((x[np.minimum(at, n - 1)] == part).sum())
        if to:
            rest = n - int(np.searchsorted(x, a[to - 1], "right"))
        own = size[low:high]
        if overlap + min(rest, int(own.max()) - to) < need(n, int(own.min()), percent):
            continue
        while low < high and len(keys[low]) == to:
            if overlap >= need(n, to, percent):
                out.append(rows[low][0])
            low += 1
        while low < high:
            token, k = keys[low][to], low + 1
            while k < high and keys[k][to] == token:
                k += 1
            stack.append((low, k, to, overlap))
            low = k
    return out


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        column = batch.column(at).cast(pa.binary())
        for a, b in slices([x or 0 for x in pa.compute.binary_length(column).to_pylist()], SLICE):
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()


def _survey(n: int) -> Callable:
    """Rows (row, n, sig) of documents, and at a partition's end its counters in slices (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch, texts in _texts(batches, 1):
            sets = shingles(texts, n)
            every = np.concatenate(sets)
            counts += np.bincount((every >> _U(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], ["row", "n", "sig", "part", "counts"])
        if counts.any():
            parts = [p.astype("<u4").tobytes() for p in np.split(counts, PARTS)]
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["row", "n", "sig", "part", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (part, counts) for each part of a partition: the sum of its slices."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(raw, "<u4").astype(np.uint64)
            sums[part] = sums[part] + c if part in sums else c
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(c, 0xFFFFFFFF).astype("<u4").tobytes() for c in sums.values()], pa.binary())], ["part", "counts"])


def rarity(survey: DataFrame) -> np.ndarray:
    """For each counter the class of its count, in quarter powers of two: PARTS rows, COUNTERS numbers at most reach the driver."""
    parts = survey.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(_added, "part int, counts binary")
    counts = np.zeros((PARTS, COUNTERS // PARTS), np.uint32)
    for r in parts.collect():
        counts[r.part] = np.frombuffer(r.counts, "<u4")
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(counts.ravel(), 1)))).astype(np.uint8)


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (probe, block, kind, sig, keys), sorted by them: in each block the probe's own row comes first, its partners follow."""
    own, x, rows = None, None, []
    a: list[int] = []
    b: list[int] = []

    def close() -> None:
        if rows:
            found = trie_join(x, rows, percent)
            a.extend([own[0]] * len(found))
            b.extend(found)
            rows.clear()

    for batch in batches:
        for probe, block, kind, sig, keys in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (probe, block) != own:
                close()
                own = (probe, block)
            if kind == 0:
                x = np.frombuffer(keys, ">u8").astype(_U)
            else:
                rows.append((sig, keys))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = [], []
    close()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _dealt(pairs: DataFrame) -> DataFrame:
    """(probe, block, kind, sig): the partners of each of pairs(probe, sig) dealt to blocks of about TRIE sets, each with the probe's own row."""
    sized = pairs.groupBy("probe").agg(F.ceil(F.count("*") / F.lit(TRIE)).cast("int").alias("blocks"))
    partners = pairs.join(sized, "probe").select("probe", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "sig")
    return partners.union(sized.select("probe", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("probe").alias("sig")))


def _near(percent: int) -> Column:
    """Whether the sizes and 512-bit summaries of sets x and y leave a link possible: each member flips one bit, so these differ in no more bits than the sets do in members."""
    apart = F.lit(0)
    for k in range(8):
        apart = apart + F.bit_count(F.col(f"x_b{k}").bitwiseXOR(F.col(f"y_b{k}")))
    need_ = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent) - 1e-9)
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (apart <= F.col("x_n") + F.col("y_n") - 2 * need_)


def _near_wide(percent: int) -> Column:
    """The same by summaries as wide as the sets are large; sets without one pass. Of two widths the wider is folded: its halves' bits flip each other."""
    half = lambda w: F.expr(f"size({w}) div 2")
    folded = lambda w: F.zip_with(F.slice(w, F.lit(1), half(w)), F.slice(w, half(w) + 1, half(w)), lambda a, b: a.bitwiseXOR(b))
    x, y = (F.when(F.size(a) > F.size(b), folded(a)).otherwise(F.col(a)) for a, b in (("x_wide", "y_wide"), ("y_wide", "x_wide")))
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, k: a + k)
    need_ = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent) - 1e-9)
    return F.col("x_wide").isNull() | F.col("y_wide").isNull() | (apart <= F.col("x_n") + F.col("y_n") - 2 * need_)


def classes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """row, doc_id, n, class of every row: rows that links lead between are of one class; rows without shingles have none.

    Two rows link when 100 * intersection >= percent * union of their n-word shingle sets. Null and empty
    texts have no shingles and link with nothing; shorter texts have one. Equal sets are one class. No rows: no
    rows. Extra columns are not looked at. Rows are told apart by their place in their file.

    Two sets link only if they share one of the rarest |x| - ceil(percent |x|) + 1 shingles of each. Sets
    that meet there are first held against the meeting's hub, the set of the most frequent shingles (so a
    group of near copies costs in proportion to its size); then sets that meet and are still in different
    components are held against each other, all of them.
    """
    df = common.numbered(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    docs = df.select("row", "text")
    survey = common.keep(docs.mapInArrow(_survey(n), "row long, n long, sig long, part int, counts binary"), "survey")
    own = survey.where("part is null").select("row", "n", "sig")
    classes = docs.sparkSession.sparkContext.broadcast(rarity(survey))  # COUNTERS bytes

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of a partition's documents
        for batch, texts in _texts(batches, 1):
            token, sig, cores, fact = [], [], [], []
            for row, s in zip(batch.column(0).to_pylist(), shingles(texts, n)):
                if len(s) and (name := signature(s)) not in seen:
                    seen.add(name)
                    keys = ordered(s, classes.value)
                    rare = keys[-(len(s) + percent * len(s) // -100 + 1) :]
                    token.append(rare)
                    sig.append(np.full(len(rare), name, np.int64))
                    core = round(2 * float(255 - (keys >> _U(56)).mean()))
                    cores.append(np.full(len(rare), core, np.int16))
                    bits = np.packbits(np.bincount((keys & _U(511)).astype(np.int64), minlength=512) & 1).view(np.int64)
                    wide = 1 << (len(s) - 1).bit_length()
                    wide = np.packbits(np.bincount((keys & _U(wide - 1)).astype(np.int64), minlength=wide) & 1).view(np.int64) if wide > 512 else None
                    fact.append((name, core, row, len(s), *bits.tolist(), wide))
            if token:
                none = pa.nulls(sum(map(len, sig)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(sig)), pa.array(np.concatenate(cores)), *[none] * 10, pa.nulls(len(none), pa.list_(pa.int64()))], names)
                sig_, core_, *rest, wides = zip(*fact)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(fact), pa.int64()), pa.array(sig_, pa.int64()), pa.array(core_, pa.int16()), *(pa.array(v, pa.int64()) for v in rest), pa.array(wides, pa.list_(pa.int64()))], names)

    names = ["token", "sig", "core", "row", "n", *(f"b{k}" for k in range(8)), "wide"]
    posted = common.keep(docs.mapInArrow(posts, "token long, sig long, core short, row long, n long, " + ", ".join(f"b{k} long" for k in range(8)) + ", wide array<long>"), "posts")
    # One exchange by token serves the counts and the join with them.
    tokens = posted.where("token is not null").select("token", "sig", "core").repartition("token")
    met = tokens.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.max_by("sig", "core").alias("hub")).where("low <> high").select("token", "hub")
    members = common.keep(tokens.join(met, "token").select("token", "sig", "hub", "core"), "members")  # core: so that both read the same exchange
    facts = posted.where("token is null").drop("token", "core").groupBy("sig").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", *(f"b{k}" for k in range(8)))])
    wide = posted.where("wide is not null").select("row", "wide")
    facts = common.keep(facts.join(members.select("sig").distinct(), "sig").join(wide, "row", "left"), "facts")
    common.discard(posted)
    bare = facts.drop("row", "wide")
    sides = lambda c, df: df.select(*[F.col(k).alias(f"{c}_{k}") for k in df.columns])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keyed() -> Iterator[pa.RecordBatch]:
            for batch, texts in _texts(batches, 4):
                made = [ordered(s, classes.value).astype(">u8").tobytes() for s in shingles(texts, n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(made, pa.binary())], ["probe", "block", "kind", "sig", "keys"])

        return _pairs(keyed(), percent)

    def likely(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs(x_sig, y_sig, ...) whose wide summaries leave a link possible: no text is moved for the others."""
        sized = facts.select("sig", "n", "wide")
        near = pairs.join(sides("x", sized), "x_sig").join(sides("y", sized), "y_sig").where(_near_wide(percent))
        return near.select(*pairs.columns)

    def links_among(pairs: DataFrame, tag: str) -> DataFrame:
        """Links among distinct pairs(probe, sig)."""
        chosen = common.keep(pairs, tag)
        asked = common.keep(_dealt(chosen).join(facts.select("sig", "row"), "sig"), "asked")
        common.discard(chosen)
        touched = docs.where(common.may_hold(common.bitmap(asked, "row"), "row")).join(asked, "row").select("probe", "block", "kind", "sig", "text")
        rows = touched.repartition("probe", "block").sortWithinPartitions("probe", "block", "kind", "sig")
        found = common.keep(rows.mapInArrow(joined, "a long, b long"), "links")
        common.discard(asked)
        return found

    hub_pairs = members.where("sig <> hub").select(F.col("sig").alias("x_sig"), F.col("hub").alias("y_sig")).groupBy("x_sig", "y_sig").agg(F.count("*").alias("met"))
    hub_pairs = hub_pairs.join(sides("x", bare), "x_sig").join(sides("y", bare), "y_sig").where(_near(percent))
    best = likely(hub_pairs.select("x_sig", "y_sig", "met")).groupBy("x_sig").agg(F.max_by("y_sig", "met").alias("y_sig"))
    links = links_among(best.select(F.col("y_sig").alias("probe"), F.col("x_sig").alias("sig")), "hub-pairs")
    roots = common.keep(common.components(links), "roots")
    placed = members.select("token", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")).repartition("token")
    split = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    open_ = common.keep(placed.join(split, "token").distinct().join(bare, "sig"), "open")
    common.discard(members)
    x, y = sides("x", open_), sides("y", open_)
    rest = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_sig") < F.col("y_sig")) & (F.col("x_root") != F.col("y_root")) & _near(percent))
    rest = likely(rest.select("x_sig", "y_sig").distinct())
    links = links.union(links_among(rest.select(F.col("x_sig").alias("probe"), F.col("y_sig").alias("sig")), "open-pairs"))
    roots = common.components(links).withColumnRenamed("node", "sig")
    ids = df.select("row", "doc_id")
    return common.keep(ids.join(own, "row").join(roots, "sig", "left").select("row", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "sig")).alias("class")), "classes")


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links lead to, the row's own included.

    Equal rows fall together; a row without doc_id takes the smallest doc_id of its component, or null.
    Rows without shingles stand alone. For what links see classes_of().
    """
    rows = classes_of(df, id_col, text_col, n, percent)
    least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    some = rows.where("n > 0").join(least, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """df with one row of each class, that of the smallest doc_id (of equal ones the first read); rows without shingles stay. All columns pass through."""
    columns, every = df.columns, common.numbered(df, "__row")
    rows = classes_of(every.select(*columns), id_col, text_col, n, percent).where("n > 0")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    gone = common.keep(rows.join(first, "class").where("row <> first.row").select(F.col("row").alias("__row")), "gone")
    touched = common.may_hold(common.bitmap(gone, "__row"), "__row")
    return every.where(~touched).union(every.where(touched).join(gone, "__row", "left_anti").select(*every.columns)).drop("__row")
