"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words that together cover its whole text. Each passage becomes a feature
vector (frequencies of byte kinds, word shape and repetition, hashed words), a hidden vector, and a gated attention
weight ``softmax(w . (tanh(V h) * sigmoid(U h)))`` over its document. The weighted sum of hidden vectors is scored by a
logistic unit. All weights are learned from document labels alone, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging, text

PASSAGE = 64
BUCKETS = 64
HIDDEN, GATE = 32, 16
#: Bounds of the training sample: labelled documents, and passages held by the driver.
SAMPLE_DOCS, SAMPLE_PASSAGES = 4000, 120_000
THRESHOLD = 0.3
HELD_OUT = 5

# byte kinds: each ASCII sign by itself, then digits, lower, upper, non-ASCII, blank, line end, other control
_KIND = np.zeros(256, np.int64)
_signs = [b for b in range(0x21, 0x7F) if not (0x30 <= b < 0x3A or 0x41 <= b < 0x5B or 0x61 <= b < 0x7B)]
for _i, _b in enumerate(_signs):
    _KIND[_b] = _i
_KIND[0x30:0x3A] = len(_signs)
_KIND[0x61:0x7B] = len(_signs) + 1
_KIND[0x41:0x5B] = len(_signs) + 2
_KIND[0x80:] = len(_signs) + 3
_KIND[0x20] = len(_signs) + 4
_KIND[0x0A] = len(_signs) + 5
_KIND[[*range(0x0A), *range(0x0B, 0x20), 0x7F]] = len(_signs) + 6
KINDS = len(_signs) + 7
FEATURES = KINDS + BUCKETS + 8


def passages(buf: np.ndarray, offsets: np.ndarray, powers: text.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the number of passages per document (one at least)."""
    s, e, w = text.spans(buf, offsets, text.NOT_SPACE)
    n_words = np.diff(w)
    many = np.maximum(1, -(-n_words // PASSAGE))
    doc = np.repeat(np.arange(len(many)), many)
    first_word = w[:-1][doc] + PASSAGE * text.ragged(np.zeros(len(many), np.int64), many)
    last_word = np.minimum(first_word + PASSAGE, w[1:][doc])
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    padded = np.append(s, len(buf))
    begin = np.where(new_doc, offsets[:-1][doc], padded[np.minimum(first_word, len(s))])
    size = np.diff(np.append(begin, len(buf)))
    rows = len(doc)
    x = np.zeros((rows, FEATURES), np.float32)
    if not rows:
        return x, many
    of_byte = np.repeat(np.arange(rows), size)
    x[:, :KINDS] = np.bincount(of_byte * KINDS + _KIND[buf], minlength=rows * KINDS).reshape(rows, KINDS)
    x[:, :KINDS] /= np.maximum(size, 1)[:, None]
    count = last_word - first_word
    of_word = np.repeat(np.arange(rows), count)
    h = text.span_hash(text.prefix_hash(text.LOWER[buf], powers), s, e, powers)
    bag = np.bincount(of_word * BUCKETS + (h >> np.uint64(58)).astype(np.int64), minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    n = np.maximum(count, 1)
    x[:, KINDS:KINDS + BUCKETS] = np.sqrt(bag / n[:, None])
    at = KINDS + BUCKETS
    length = (e - s).astype(np.float64)
    mean = np.bincount(of_word, length, rows) / n
    x[:, at] = np.log1p(mean)
    x[:, at + 1] = np.sqrt(np.maximum(0, np.bincount(of_word, length ** 2, rows) / n - mean ** 2)) / 10
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    x[:, at + 2] = np.bincount(of_word, same, rows) / n
    key = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    x[:, at + 3] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=rows) / n
    runs = np.diff(np.append(np.flatnonzero(new), len(key)))
    top = np.zeros(rows)
    np.maximum.at(top, (key[new] >> np.uint64(40)).astype(np.int64), runs)
    x[:, at + 4] = top / n
    lead = buf[s] if len(s) else np.zeros(0, np.uint8)
    tail = buf[e - 1] if len(e) else lead
    x[:, at + 5] = np.bincount(of_word, (lead >= 0x41) & (lead < 0x5B), rows) / n
    x[:, at + 6] = np.bincount(of_word, _KIND[tail] < len(_signs), rows) / n
    x[:, at + 7] = count == 0
    return x, many


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Model:
    """Encoder, gated attention and scorer; weights are plain arrays."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.center, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"W": r.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
                  "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
                  "w": r.normal(0, GATE ** -0.5, GATE), "c": r.normal(0, HIDDEN ** -0.5, HIDDEN), "d": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, np.cumsum(many) - many
        x = np.clip((x - self.center) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * g) @ p["w"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, at), many))
        a = raw / np.repeat(np.add.reduceat(raw, at), many)
        z = np.add.reduceat(a[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, many: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f, at = self.p, self.forward(x, many), np.cumsum(many) - many
        d_out = ((f["y"] - label) / len(label)).astype(np.float32)
        d_z = np.repeat(d_out[:, None] * p["c"], many, axis=0)
        d_a = (d_z * f["h"]).sum(1)
        d_raw = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, at), many))
        d_t = d_raw[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        d_g = d_raw[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * d_z + d_t @ p["V"].T + d_g @ p["U"].T
        d_x = d_h * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ d_x, "b": d_x.sum(0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g,
                "w": (f["t"] * f["g"]).T @ d_raw, "c": f["z"].T @ d_out, "d": d_out.sum(keepdims=True)}

    def fit(self, x: np.ndarray, many: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3,
            decay: float = 1e-4, seed: int = 5) -> Model:
        """Adam over document batches in a fixed random order."""
        if not len(label):
            return self
        self.center, self.scale = x.mean(0), x.std(0) + 1e-3
        r, ends = np.random.default_rng(seed), np.cumsum(many)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(label))
            for i in range(0, len(order), batch):
                docs = order[i:i + batch]
                rows = text.ragged((ends - many)[docs], many[docs])
                grad = self.gradient(x[rows], many[docs], label[docs])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training, by the CRC-32 of its identifier as text."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """A model fitted to labelled documents outside the held-out fold.

    Of the labelled identifiers the ``sample_docs`` with the smallest hash are used, as far as ``sample_passages`` go;
    the sample, and with it the driver's memory, does not grow with the table. Several labels of one document count as
    the largest; labels or identifiers that are null are left out. Without any label the score is 0.5 for every text.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_label"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out("_id"))
    chosen = rows.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    staging.batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    picked = texts.join(F.broadcast(chosen), "_id")  # at most sample_docs rows of two numbers

    def run(batches):
        powers = text.Powers()
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            for i, j in text.pieces(offsets):
                x, many = passages(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], powers)
                ends = np.cumsum(many)
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").slice(i, j - i), batch.column("_label").slice(i, j - i), pa.array(many),
                    pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip((ends - many).tolist(), ends.tolist())], pa.binary())],
                    names=["_id", "_label", "many", "x"])

    kind = dict(texts.dtypes)["_id"]
    bags = staging.stage(spark, picked.mapInArrow(run, f"_id {kind}, _label double, many long, x binary"))
    x, many, label, total = [], [], [], 0
    for r in bags.orderBy(F.xxhash64("_id"), "_id", "x").toLocalIterator():
        if total + r["many"] > sample_passages:
            continue
        total += r["many"]
        x.append(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES))
        many.append(r["many"])
        label.append(float(r["_label"] > 0))
    model = Model()
    if not label:
        model.p["c"][:] = 0
        return model
    return model.fit(np.concatenate(x), np.array(many), np.array(label, np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted``, the number of passages, and the passage with most attention with its weight.

    Every row gives a row. A null or empty text is one passage without words and gets a score like any other. Identifiers
    are no input; a null identifier is not held out. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.center, model.scale, model.p))

    def run(batches):
        powers, m = text.Powers(), Model()
        m.center, m.scale, m.p = shared.value
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            for i, j in text.pieces(offsets):
                x, many = passages(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], powers)
                f, at = m.forward(x, many), np.cumsum(many) - many
                best = np.maximum.reduceat(f["a"], at)
                first = np.flatnonzero(f["a"] == np.repeat(best, many))
                top = first[np.searchsorted(first, at)] - at
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").slice(i, j - i), pa.array(f["y"].astype(np.float64)), pa.array(many),
                    pa.array(top), pa.array(best.astype(np.float64))], names=["_id", "score", "n_passages", "top_passage", "top_weight"])

    staging.batches(docs.sparkSession)
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(run, f"_id {kind}, score double, n_passages long, top_passage long, top_weight double")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.center, model.scale, model.p))

    def run(batches):
        powers, m = text.Powers(), Model()
        m.center, m.scale, m.p = shared.value
        for batch in batches:
            buf, offsets = text.flat(batch.column(text_col))
            y = [m.forward(*passages(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], powers))["y"] for i, j in text.pieces(offsets)]
            yield batch.filter(pa.array(np.concatenate(y) >= threshold)) if y else batch

    staging.batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
