"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tokencount import Words, bytes_to_chars, ranges, slices

# Fixed value: how the vocabulary's tokenizer finds words in lower-case text, of letters L, numbers N and white space S.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^SLN]+"
# The same where every character is in Latin-1, for the faster of two matchers.
_LATIN_L, _LATIN_N, _LATIN_S = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN_L}]+|[{_LATIN_N}]|[^{_LATIN_S}{_LATIN_L}{_LATIN_N}]+"
#: Words that a worker remembers: twice so many.
MOST_WORDS = 200_000
#: Bytes of text handled at once.
SLICE = 1 << 22


@lru_cache(2)
def words_pattern(last: int) -> re.Pattern:
    """WORDS with the code points of letters, numbers and white space up to `last` in place: the shorter classes are much faster."""
    points = {k: "".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in ranges(p) if a <= last) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    return re.compile(re.sub("[LNS]", lambda m: points[m[0]], WORDS))


@lru_cache(1)
def unassigned() -> re.Pattern:
    """What Python's Unicode tables don't know yet in the first plane, and all beyond it."""
    return re.compile("[" + "".join(f"\\u{k:04x}" for k in range(0x10000) if unicodedata.category(chr(k)) == "Cn") + "\U00010000-\U0010ffff]")


@lru_cache(1)
def library_normal():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


class WordTokenizer:
    """Words and texts to ids and back; words: word -> (ids as text, number of ids, decoded text), by the merges if it's not remembered."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        # Symbols are numbered as they are met; a pair is one number, its merge (rank, symbol made).
        self.number: dict[str, int] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merge = {self._symbol(a) << 32 | self._symbol(b): (k, self._symbol(a + b)) for k, (a, b) in enumerate(pairs)}
        self.byte = [self._symbol(c) for _, c in sorted(bytes_to_chars().items())]
        self.last_byte = [self._symbol(c + self.end) for _, c in sorted(bytes_to_chars().items())]
        self.token = [self.vocab.get(s) for s in self.number]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.words = Words(self.round_trip, MOST_WORDS)
        self.latin = re.compile(LATIN_WORDS)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _symbol(self, s: str) -> int:
        return self.number.setdefault(s, len(self.number))

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word. The queue holds rank * n + place; an entry is stale if the pair at its place has another rank by now."""
        data, merge = word.encode("utf-8", "replace"), self.merge.get
        n, byte = len(data), self.byte
        symbols = [byte[b] for b in data]
        symbols[-1] = self.last_byte[data[-1]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        found = [merge(a << 32 | b) for a, b in zip(symbols, symbols[1:])]
        found.append(None)
        queue = [m[0] * n + k for k, m in enumerate(found) if m]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, k = divmod(pop(queue), n)
            m = found[k]
            if m is None or m[0] != rank:
                continue  # stale: one of the two has been merged since
            other = after[k]
            symbols[k], symbols[other], found[other] = m[1], -1, None
            after[k] = follower = after[other]
            if follower >= 0:
                before[follower] = k
                m = found[k] = merge(symbols[k] << 32 | symbols[follower])
                if m:
                    push(queue, m[0] * n + k)
            else:
                found[k] = None
            a = before[k]
            if a >= 0:
                m = found[a] = merge(symbols[a] << 32 | symbols[k])
                if m:
                    push(queue, m[0] * n + a)
        token = self.token
        return [token[s] for s in symbols if s >= 0 and token[s] is not None]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings one after the other; this file names no decoder, so they keep their word ends and stand apart by a space, as the library has it."""
        return " ".join(self.strings[i] for i in ids)

    def round_trip(self, word: str) -> tuple[str, int, str]:
        ids = self.encode_word(word)
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii() and unassigned().search(text):
            return library_normal().normalize_str(text)  # newer characters may have small letters and compositions
        text = unicodedata.normalize("NFC", text)
        # Character by character: str.lower() alone looks at neighbours for the final sigma.
        return "σ".join(p.lower() for p in text.split("Σ")) if "Σ" in text else text.lower()

    def text(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by a space, decoded text) of a whole text."""
        found: list[tuple[str, int, str]] = []
        get = self.words.__getitem__
        for part in self.parts.split(text) if self.parts and "<|" in text else (text,):
            if part in self.special:
                found.append((str(self.special[part]), 1, part))
            else:
                part = self.normal(part)
                try:
                    part.encode("latin-1")
                    words = self.latin.findall(part)
                except UnicodeEncodeError:
                    words = words_pattern(0xFFFF if max(part) < "\U00010000" else 0x10FFFF).findall(part)
                found += map(get, words)
        ids, n, strings = zip(*found) if found else ((), (), ())
        if 0 in n:  # words without any token
            ids, strings = filter(None, ids), (s for s, k in zip(strings, n) if k)
        return sum(n), " ".join(ids), " ".join(strings)


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """doc_id, n_tokens and, by digest, ids_sha256 and decoded_sha256, or the ids (array<int>) and decoded text themselves.

    Null text counts as empty: no tokens. Equal rows give equal results; no rows give none. Texts are
    taken whole, of any length. The file must be where the workers can open it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            column = batch.column(1)
            for a, b in slices([x or 0 for x in pa.compute.binary_length(column).to_pylist()], SLICE):
                rows = (t.text(x or "") for x in column.slice(a, b - a).to_pylist())
                rows = [(n, sha(ids), sha(text)) if digest else (n, [int(i) for i in ids.split()], text) for n, ids, text in rows]
                n, ids, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(text, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, {names[2]} {'string' if digest else 'array<int>'}, {names[3]} string")
