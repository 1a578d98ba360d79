"""Token counts by finite-state transducers: a pre-tokenizer whose chunk maps compose in a prefix scan, and byte-pair merges as transitions that carry token counts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Classes of characters. The letters of contractions have classes of their own; _END stands between texts, _PAD fills the last chunk.
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE, _QUOTE, _STMD, _RV, _E, _L, _END, _PAD = range(12)
# States: what the last characters read may still become.
START, ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE, WORD, DIGITS, SIGNS, QUOTED, QUOTED_RV, QUOTED_L, CLOSED = range(12)
_STATES = 12
#: Characters of a chunk, and of the texts that are handled at once.
CHUNK, SLICE = 64, 1 << 19
#: States and pairs of tokens that a worker holds; of each it drops all beyond that number and goes on. Words: twice so many.
MOST_STATES, MOST_PAIRS, MOST_WORDS = 1_000_000, 600_000, 250_000


def bytes_to_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is visible in Latin-1, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(4)
def ranges(pattern: str) -> list[tuple[int, int]]:
    """The code points of a character class, as (first, last), by the Unicode tables of the tokenizers library: those of Python and of the regex module are of other versions."""
    from tokenizers import Regex, normalizers

    kept, inside = normalizers.Replace(Regex(f"[^{pattern}]"), ""), np.zeros(0x110000, bool)
    for low in range(0, 0x110000, 4096):  # in blocks: the library holds much more than the text
        found = kept.normalize_str("".join(chr(k) for k in range(low, low + 4096) if not 0xD800 <= k < 0xE000))
        inside[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = True
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
    return [(a, b - 1) for a, b in zip(edge[::2], edge[1::2])]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        for first, last in ranges(pattern):
            out[first : last + 1] = kind
    for chars, kind in (("\x1c\x1d\x1e\x1f", _OTHER), (" ", _BLANK), ("'", _QUOTE), ("stmd", _STMD), ("rv", _RV), ("e", _E), ("l", _L)):
        for c in chars:
            out[ord(c)] = kind
    return out


@lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by class and state. Emission bit 0: a pre-token begins at this character; bit 1: one begins at the character before."""
    to, out = np.zeros((12, _STATES), np.uint8), np.zeros((12, _STATES), np.uint8)
    letters = (_LETTER, _STMD, _RV, _E, _L)
    for state in range(_STATES):
        for kind in range(12):
            if kind == _PAD:
                to[kind, state] = state
                continue
            pending = state in (QUOTED_RV, QUOTED_L)
            if pending and (kind == _E and state == QUOTED_RV or kind == _L and state == QUOTED_L):
                to[kind, state] = CLOSED
                continue
            if state == QUOTED and kind in (_STMD, _RV, _L):
                to[kind, state] = CLOSED if kind == _STMD else QUOTED_RV if kind == _RV else QUOTED_L
                continue
            emit = 2 if pending else 0  # no contraction: the letter after the quote begins a word
            was = WORD if pending else SIGNS if state == QUOTED else state
            run = was in (ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE)
            if kind == _END:
                to[kind, state], out[kind, state] = START, emit | 1
            elif kind in (_BLANK, _SPACE):
                to[kind, state] = (MORE_BLANK if kind == _BLANK else MORE_SPACE) if run else (ONE_BLANK if kind == _BLANK else ONE_SPACE)
                out[kind, state] = emit | (not run)
            else:
                goal = WORD if kind in letters else DIGITS if kind == _NUMBER else SIGNS
                if was in (MORE_BLANK, MORE_SPACE):  # of a run of white space the last one stands apart
                    emit |= 2
                joined = was == goal or was in (ONE_BLANK, MORE_BLANK)
                if kind == _QUOTE and not joined:
                    goal = QUOTED
                to[kind, state], out[kind, state] = goal, emit | (not joined)
    return to, out


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, for a sequence of character classes.

    The map from entry to exit state is made for all chunks side by side; the maps are composed in a
    parallel prefix scan, which gives every chunk's true entry state; then all chunks emit side by side.
    """
    to, out = (t.ravel() for t in transducer())
    n = len(kinds)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, _PAD, np.uint8)
    padded[:n] = kinds
    by_step = np.ascontiguousarray(padded.reshape(rows, CHUNK).T).astype(np.intp) * _STATES
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for step in by_step:
        maps = to[step[:, None] + maps]
    reach = 1
    while reach < rows:
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)])
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    emitted = np.empty((CHUNK, rows), np.uint8)
    for k, step in enumerate(by_step):
        at = step + state
        emitted[k], state = out[at], to[at]
    emitted = np.ascontiguousarray(emitted.T).ravel()[:n]
    begins = (emitted & 1).astype(bool)
    begins[:-1] |= (emitted[1:] & 2) > 0
    return np.flatnonzero(begins)


class Words(dict):
    """word -> what make(word) gives. Once it holds `most` words they become the older half; of these, words met again return, the others go."""

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Merges:
    """Byte-pair merges compiled, as words are met, to a transducer over bytes.

    A state stands for the bytes read of a word. It holds the last token of their encoding; a transition
    holds how many tokens it adds (or takes away). The last token after one more byte is the one suffix in
    the vocabulary that can follow the last token before it: two tokens can stand side by side if the
    merges, run on their joined bytes, give just these two.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, back = whole["model"], {c: b for b, c in bytes_to_chars().items()}
        self.ids = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token)}
        self.text = {i: t for t, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        byte = lambda s: bytes(back[c] for c in s)
        self.merge = {(self.ids[byte(a)], self.ids[byte(b)]): (k, self.ids[byte(a + b)]) for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        sizes: dict[bytes, set[int]] = {}
        for t in self.ids:
            sizes.setdefault(t[-3:], set()).add(len(t))
        # By a word's last three bytes the lengths, longest first, that a token at its end may have.
        self.sizes = {end: (*sorted((n for n in of if n > 2), reverse=True), 2, 1) for end, of in sizes.items() if len(end) == 3}
        self.special = [t["content"] for t in whole["added_tokens"]]
        self.fits: dict[int, bool] = {}
        self.words = Words(self.count, MOST_WORDS)
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}
        self.last, self.tokens = [-1], [0]

    def merged(self, ids: list[int]) -> list[int]:
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def beside(self, a: int, b: int) -> bool:
        """a may be followed by b (a is -1 where b comes first)."""
        key = (a + 1) << 20 | b
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) > MOST_PAIRS:
                self.fits.clear()
            parts = ([] if a < 0 else [a]) + [b]
            fit = self.fits[key] = self.merged([self.ids[bytes([x])] for t in parts for x in self.text[t]]) == parts
        return fit

    def step(self, read: bytes, last: list[int], path: Sequence[int]) -> tuple[int, int]:
        """(last token, its length) after reading `read`; last[path[n]] is the last token after its first n bytes."""
        n, ids, fits = len(read), self.ids.get, self.fits.get
        for size in self.sizes.get(read[-3:], (2, 1)):
            if size <= n:
                token = ids(read[n - size :])
                if token is not None:
                    a = last[path[n - size]]
                    fit = fits((a + 1) << 20 | token)
                    if fit or fit is None and self.beside(a, token):
                        return token, size
        raise ValueError("a byte without a token")

    def count(self, word: str) -> int:
        data = word.encode()
        if len(data) > 200:  # too rare to keep states for
            last, tokens = [-1], [0]
            for n in range(1, len(data) + 1):
                begin = max(0, n - self.longest - 1)
                token, size = self.step(data[begin:n], last, range(begin, n + 1))
                last.append(token)
                tokens.append(tokens[n - size] + 1)
            return tokens[-1]
        if len(self.last) > MOST_STATES:
            self.reset()
        state, emitted, path = 0, 0, [0]
        for n, byte in enumerate(data, 1):
            key = state << 8 | byte
            to = self.next.get(key)
            if to is None:
                token, size = self.step(data[:n], self.last, path)
                to = self.next[key] = len(self.last)
                self.last.append(token)
                self.tokens.append(self.tokens[path[n - size]] + 1 - self.tokens[state])  # what the transition into it emits
                self.tokens[to] += self.tokens[state]
            emitted += self.tokens[to] - self.tokens[state]
            state = to
            path.append(state)
        return emitted


@lru_cache(1)
def _merges(path: str) -> Merges:
    return Merges(path)


def count_texts(texts: list[str], merges: Merges) -> list[int]:
    """The tokens of each text; strings of special tokens count one and part the text, as the library has it."""
    parts: list[str] = []
    owner: list[int] = []
    totals = [0] * len(texts)
    split = regex.compile("|".join(regex.escape(s) for s in merges.special)) if merges.special else None
    for k, text in enumerate(texts):
        pieces = split.split(text) if split and any(s in text for s in merges.special) else [text]
        totals[k] += len(pieces) - 1
        parts += pieces
        owner += [k] * len(pieces)
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[points]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kinds[ends] = _END
    at = boundaries(kinds)
    cuts = [*at.tolist(), len(joined)]
    counts = np.fromiter(map(merges.words.__getitem__, [joined[a:b] for a, b in zip(cuts, cuts[1:])]), np.int64, len(at))
    counts[kinds[at] == _END] = 0
    sums = np.concatenate([[0], np.cumsum(counts)])
    stop = np.searchsorted(at, ends, "left")
    start = np.concatenate([[0], stop[:-1]])
    for k, n in zip(owner, (sums[stop] - sums[start]).tolist()):
        totals[k] += n
    return totals


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of neighbours whose lengths sum up to about `most`."""
    begin = total = 0
    for k, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def count(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text, for the byte-level tokenizer file at path.

    Null text counts as empty: no bytes, no tokens. Equal rows give equal results; no rows give none; long
    texts run in chunks. The file must be where the workers can open it, as an installed package's is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path)
        for batch in batches:
            column = batch.column(1)
            sizes = [x or 0 for x in pa.compute.binary_length(column).to_pylist()]
            for a, b in slices(sizes, SLICE):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                totals = count_texts(texts, merges)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(totals, pa.int64()), pa.array([t > limit for t in totals], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
