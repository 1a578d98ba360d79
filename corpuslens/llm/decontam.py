"""Benchmark decontamination: an FM-index per training shard, searched for every window of the benchmark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokencount import slices

WINDOW = 13
#: Symbols of one index, and bytes of text of one batch.
SHARD_SYMBOLS, SLICE = 1 << 19, 1 << 21
#: Every so many text positions the index keeps the suffix's place.
SAMPLE = 32
#: Bytes of benchmark text that are sent to the workers at once; a larger benchmark goes in several passes.
BLOCK_BYTES = 32 << 20

#: Byte by byte: letters in lower case, other word bytes (digits, all beyond ASCII) themselves, the rest a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Patterns:
    """The benchmark's windows over its own vocabulary: symbol 0 is any other word."""

    def __init__(self, items: list[tuple[object, bytes]]) -> None:
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + WINDOW]), {})[item] = None
        self.windows = list(found)
        self.items = [list(v) for v in found.values()]
        self.least = min(map(len, self.windows), default=0)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.windows):
            by.setdefault(len(w), []).append(k)
        self.by_length = [(np.array(ks), np.array([self.windows[k] for k in ks], np.int64)) for ks in by.values()]


class Wavelet:
    """A wavelet matrix: one bit vector a level, with ranks from block sums and population counts."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.n, self.bits, self.sums, self.zeros = len(symbols), [], [], []
        row = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        return self.sums[level][block] + np.bitwise_count(self.bits[level][block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many times each symbol stands before place i."""
        first = np.zeros_like(i)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, first), self._ones(k, i)
            first, i = np.where(one, self.zeros[k] + a, first - a), np.where(one, self.zeros[k] + b, i - b)
        return i - first

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the symbol at each place, how many times it stands before)."""
        symbol, first = np.zeros_like(i), np.zeros_like(i)
        for k in range(self.levels):
            one = ((self.bits[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | one
            a, b = self._ones(k, first), self._ones(k, i)
            first, i = np.where(one, self.zeros[k] + a, first - a), np.where(one, self.zeros[k] + b, i - b)
        return symbol, i - first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; each 0 is a symbol of its own, by its place, so the longest stretch between zeros bounds the rounds."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()))
    _, rank = np.unique(rank, return_inverse=True)
    rank, reach = rank.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - reach] += rank[reach:] + 1 if reach < n else 0
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[order[-1]] == n - 1:
            return order
        rank, reach = new, reach * 2


class FMIndex:
    """An index of stretches of symbols >= 1, parted by zeros."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        order = suffix_array(text)
        last = text[order - 1]  # the symbol before each suffix; that before the first one is the closing zero
        self.wavelet = Wavelet(last, size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        keep = (order % SAMPLE == 0) | (last == 0)  # a stretch's start is kept, so no walk crosses a zero
        self.place = np.where(keep, order, -1)

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern's row, place) of every occurrence of patterns of one length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.wavelet.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low, high = self.before[c] + self.wavelet.rank(c, low), self.before[c] + self.wavelet.rank(c, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        many = high - low
        who = np.repeat(alive, many)
        row = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out, steps, left = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(left):
            at = self.place[row]
            done = at >= 0
            out[left[done]] = at[done] + steps
            left, row = left[~done], row[~done]
            if len(left):
                c, seen = self.wavelet.access(row)
                row = self.before[c] + seen
                steps += 1
        return who, out


def stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of known words, as long as the shortest window at least; no window reaches beyond one."""
    known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(known))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


def search(patterns: Patterns, pieces: list[np.ndarray]) -> dict[int, tuple[list[tuple[int, int]], list]]:
    """For each stretch with occurrences: (merged spans of hit words, items)."""
    if not pieces:
        return {}
    sizes = np.array([len(p) + 1 for p in pieces])
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int64)
    for s, p in zip(starts.tolist(), pieces):
        text[s : s + len(p)] = p
    index = FMIndex(text, len(patterns.vocab) + 1)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, dict] = {}
    for ks, table in patterns.by_length:
        who, place = index.find(table)
        piece = np.searchsorted(starts, place, "right") - 1
        for w, k, at in zip(ks[who].tolist(), piece.tolist(), (place - starts[piece]).tolist()):
            spans.setdefault(k, []).append((at, at + table.shape[1]))
            items.setdefault(k, {}).update(dict.fromkeys(patterns.items[w]))
    return {k: (merge(v), list(items[k])) for k, v in spans.items()}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without its hit words, each span from the first byte of its first word to the last of its last one."""
    ends = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch], patterns: Patterns, id_type: pa.DataType, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents gather until their distinct stretches fill a shard; then the shard is indexed and searched."""
    get = patterns.vocab.get
    rows: list[tuple] = []
    seen: dict[bytes, int] = {}
    pieces: list[np.ndarray] = []
    filled = held = 0

    def flush() -> pa.RecordBatch:
        found = search(patterns, pieces)
        out = []
        for key, n, own, text in rows:
            spans, items = [], {}
            for begin, k in own:
                if k in found:
                    spans += [(begin + a, begin + b) for a, b in found[k][0]]
                    items.update(dict.fromkeys(found[k][1]))
            spans = merge(spans)
            left = cut(text, spans).decode() if with_text and spans and text is not None else None
            out.append((*key, n, [{"start": a, "end": b} for a, b in spans], list(items), left))
        row, doc, n, spans, items, left = map(list, zip(*out))
        rows.clear(), seen.clear(), pieces.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(doc, id_type), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.int64())), pa.array(left, pa.string())],
            ["row", "id", "n_words", "spans", "items", "left"],
        )

    for batch in batches:
        column = batch.column(2).cast(pa.binary())
        for a, b in slices([x or 0 for x in pa.compute.binary_length(column).to_pylist()], SLICE):
            keys = zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist())
            for key, text in zip(keys, column.slice(a, b - a).to_pylist()):
                tokens = words(text) if text else []
                own = []
                if patterns.windows and tokens:
                    ids = np.fromiter([get(w, 0) for w in tokens], np.int32, len(tokens))
                    for begin, end in stretches(ids, patterns.least):
                        raw = ids[begin:end].tobytes()
                        k = seen.get(raw)
                        if k is None:
                            k = seen[raw] = len(pieces)
                            pieces.append(ids[begin:end])
                            filled += end - begin + 1
                        own.append((begin, k))
                if with_text and own:
                    held += len(text)
                rows.append((key, len(tokens), own, text if with_text and own else None))
                if filled >= SHARD_SYMBOLS or len(rows) >= 50_000 or held >= 4 * SLICE:
                    yield flush()
                    filled = held = 0
    if rows:
        yield flush()


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", with_text: bool = False) -> DataFrame:
    """row, id, n_words, spans (of hit words, end exclusive), items (bigint ids of items with occurring windows), left (the text without its spans, on demand) of every document.

    Words are [0-9a-z] and all beyond ASCII, after lower-casing A-Z. A window is WINDOW consecutive words of
    an item; a shorter item with words is one window. Null, empty texts: no words, no spans. Items without
    words match nothing; an empty benchmark gives no spans. Equal rows give equal results. Over one pass's
    bound the benchmark goes block by block and a document's spans are united.
    """
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    docs = common.numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("row", "id", "text")
    kind = docs.schema["id"].dataType
    schema = f"row long, id {kind.simpleString()}, n_words long, spans array<struct<start:long,end:long>>, items array<long>, left string"
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64(item_text), F.lit(blocks)) == block) if blocks > 1 else items
        patterns = Patterns([(r[0], r[1].encode()) for r in own.select(item_col, item_text).where(F.col(item_text).isNotNull()).toLocalIterator()])
        sent = docs.sparkSession.sparkContext.broadcast(patterns)  # BLOCK_BYTES of text at most, about

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            return _scan(batches, sent.value, to_arrow_type(kind), with_text and blocks == 1)

        parts.append(docs.mapInArrow(run, schema))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("row", "id", "n_words").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    join = """aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> if(size(a) > 0 and x.start <= a[size(a) - 1].end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))), concat(a, array(x))))"""
    every = every.withColumn("spans", F.expr(join)).drop("s")
    if not with_text:
        return every.withColumn("left", F.lit(None).cast("string"))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(5).to_pylist(), batch.column(4).to_pylist()
            left = [cut(t.encode(), [(s["start"], s["end"]) for s in own]).decode() if own else None for t, own in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4, 3)), pa.array(left, pa.string())], ["row", "id", "n_words", "spans", "items", "left"])

    return every.join(docs.select("row", "text"), "row").select("row", "id", "n_words", "items", "spans", "text").mapInArrow(cuts, schema)


def judged(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (hits in one word of twenty at least)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return (
        found.withColumn("n_hit", hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
        .select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), "contaminated", "row", "spans", "items", "left")
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated rows; from other rows with hits the hit words are cut. Null and empty texts stay. All columns pass through. No rows: no rows."""
    columns, rows = docs.columns, common.numbered(docs, "__row")
    found = judged(find(rows.select(*columns), items, id_col, text_col, with_text=True)).where("n_hit > 0").select(F.col("row").alias("__row"), "contaminated", F.col("left").alias("__left"))
    found = common.keep(found, "hits")
    touched = common.may_hold(common.bitmap(found, "__row"), "__row")
    changed = rows.where(touched).join(found.withColumnRenamed("contaminated", "__bad"), "__row", "left").where("not coalesce(__bad, false)")
    changed = changed.withColumn(text_col, F.coalesce("__left", F.col(text_col)))
    return rows.where(~touched).select(*columns).unionByName(changed.select(*columns))
