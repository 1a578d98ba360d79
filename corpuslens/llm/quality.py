"""Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngramjoin import mix, word_hashes
from .tokencount import slices

#: Labelled documents of each class that the classifier is fitted on, those of the smallest hashes: the bound of the sample.
SAMPLE = 2000
#: Passages of a document that fitting sees, spread over all of it; scoring always takes every one.
FITTED = 64
#: Bytes of a passage, and of the texts handled at once.
PASSAGE, SLICE = 512, 1 << 20
HIDDEN, ATTENTION, ROUNDS, BAGS, RATE = 32, 16, 40, 64, 0.01
#: A document is predicted good from this score on.
THRESHOLD = 0.3

# Bytes by class: each ASCII sign its own, then digits, capitals, small letters, blanks, line ends, other controls, bytes beyond ASCII.
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.array([_SIGNS.index(b) if b in _SIGNS else len(_SIGNS) + (0 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if b == 32 else 4 if b == 10 else 5 if b < 128 else 6) for b in range(256)], np.uint8)
_BYTES = len(_SIGNS) + 7
FEATURES = _BYTES + 6


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, bounds of each text's passages). A text's passages are its stretches of PASSAGE bytes; an empty one has one, empty.

    Features: square roots of byte class shares; shares of words that repeat the one before, that are new in
    the passage's document, and of three-word runs met before in it; word length, words and bytes of the passage.
    """
    sizes = np.array([len(t or b"") for t in texts])
    many = np.maximum(1, -(-sizes // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(many)])
    total = int(bounds[-1])
    raw = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    passage = bounds[owner] + (np.arange(len(raw)) - begin[owner]) // PASSAGE
    counts = np.bincount(passage * _BYTES + _CLASS[raw], minlength=total * _BYTES).reshape(total, _BYTES).astype(np.float32)
    n_bytes = counts.sum(1)
    out = np.zeros((total, FEATURES), np.float32)
    out[:, :_BYTES] = np.sqrt(counts / np.maximum(n_bytes, 1)[:, None])
    word, at, limits = word_hashes(texts)
    if len(word):
        doc = np.repeat(np.arange(len(texts)), np.diff(limits))
        place = bounds[doc] + (at - begin[doc] - doc) // PASSAGE  # texts stand a blank apart there
        same = doc[1:] == doc[:-1]
        again = np.zeros(len(word), bool)
        again[1:] = same & (word[1:] == word[:-1])
        new = _first(mix(word ^ mix(doc.astype(np.uint64))))
        run = word.copy()
        run[2:] = mix(mix(mix(word[2:]) ^ word[1:-1]) ^ word[:-2])
        old = ~_first(mix(run ^ mix(doc.astype(np.uint64))))
        old[:2] = False
        old[2:] &= doc[2:] == doc[:-2]
        words = np.bincount(place, minlength=total)
        per = np.maximum(words, 1)
        for k, flag in enumerate((again, new, old)):
            out[:, _BYTES + k] = np.bincount(place, flag, total) / per
        out[:, _BYTES + 3] = np.minimum(n_bytes / per / 16, 4)
        out[:, _BYTES + 4] = words / 128
    out[:, _BYTES + 5] = n_bytes / PASSAGE
    return out, bounds


def _first(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """h = tanh(W f + b) for a passage; its weight is the softmax, over the document, of w (tanh(V h) * sigmoid(U h)); the score is the sigmoid of c times the weighted mean of h."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale, self.prior = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), 0.0
        self.p = {"W": normal(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, ATTENTION), "U": normal(HIDDEN, ATTENTION), "w": normal(ATTENTION, 1), "c": normal(HIDDEN, 1), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, start, size = self.p, bounds[:-1], np.diff(bounds)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((t * s) @ p["w"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
        a = e / np.repeat(np.add.reduceat(e, start), size)
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": (z @ p["c"] + p["d"])[:, 0]}

    def gradient(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f, size = self.p, self.forward(x, bounds), np.diff(bounds)
        g = ((_sigmoid(f["y"]) - label) / len(label)).astype(np.float32)[:, None]
        dz = np.repeat(g @ p["c"].T, size, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bounds[:-1]), size))
        gate = de[:, None] @ p["w"].T
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de[:, None], "c": f["z"].T @ g, "d": g.sum(0)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, prior: float, seed: int = 3) -> Model:
        """Adam over batches of documents, both classes weighing alike; then the log odds move by `prior`."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), np.maximum(every.std(0), 1e-2)
        bags = [(b - self.mean) / self.scale for b in bags]
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for round_ in range(ROUNDS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BAGS):
                own = [bags[k] for k in order[at : at + BAGS]]
                g = self.gradient(np.concatenate(own), np.cumsum([0] + [len(b) for b in own]), labels[order[at : at + BAGS]])
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * round_ / ROUNDS))
                for k, x in g.items():
                    x = x + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.prior = prior
        return self

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward((x - self.mean) / self.scale, bounds)["y"] + self.prior)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labels of up to SAMPLE documents of each class; held-out rows are never read. Without both classes it scores by the prior alone."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and __id is not null").where(~held_out(F.col("__id")))
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    model = Model()
    if len(n) < 2:
        model.p["c"][:] = 0
        model.prior = 4.0 if n.get(1) else -4.0 if n else 0.0
        return model
    h = F.xxhash64(F.lit(11), "__id")
    drawn = [known.where(f"label = {k}").orderBy(h, "__id").limit(SAMPLE) for k in (0, 1)]
    # 2 x SAMPLE thin rows: a bounded broadcast.
    own = docs.join(F.broadcast(drawn[0].union(drawn[1])), F.col(id_col) == F.col("__id")).select("__id", "label", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.binary())
            for k in range(batch.num_rows):
                x, _ = passages([column[k].as_py()])
                if len(x) > FITTED:
                    x = x[np.linspace(0, len(x) - 1, FITTED).astype(int)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).cast(pa.string()), batch.column(1).slice(k, 1), pa.array([x.astype("<f2").tobytes()], pa.binary())], ["id", "label", "x"])

    rows = sorted(own.mapInArrow(run, "id string, label int, x binary").collect(), key=lambda r: (r.id, r.label, r.x))
    bags = [np.frombuffer(r.x, "<f2").astype(np.float32).reshape(-1, FEATURES) for r in rows]
    labels_ = np.array([r.label for r in rows], np.float32)
    if not 0 < labels_.sum() < len(rows):
        model.p["c"][:] = 0
        return model
    # The log odds of the classes, against those of the sample.
    return model.fit(bags, labels_, float(np.log(n[1] / n[0]) - np.log(labels_.sum() / (len(rows) - labels_.sum()))))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row, from its whole text alone. Null text counts as empty: one empty passage. Equal texts score alike; no rows give none."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for a, b in slices([x or 0 for x in pa.compute.binary_length(column).to_pylist()], SLICE):
                y = sent.value.score(*passages(column.slice(a, b - a).to_pylist()))
                rest = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(y.astype(np.float64)), pa.array((y >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, score double, predicted int")


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that the model predicts good, all columns as they were."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.binary())
            for a, b in slices([x or 0 for x in pa.compute.binary_length(column).to_pylist()], SLICE):
                y = sent.value.score(*passages(column.slice(a, b - a).to_pylist()))
                yield batch.slice(a, b - a).filter(pa.array(y >= THRESHOLD))

    return df.mapInArrow(run, df.schema)
