"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by the
frequencies of pairs of character classes and by word statistics, and a learned layer.
Gated attention, learned from document labels alone, weighs the passages; the score is a
logistic function of the weighted passage representation. Attention logits are bounded,
so a document is scored as a running sum over its passages and its length does not
matter.

The model is fitted on the driver from labelled documents: of those with a text of at most
``TRAIN_TEXT`` bytes, chosen by hash, the first ``TRAIN_DOCS`` whose texts have at most
``TRAIN_BYTES`` bytes together. Every passage of a chosen text is read, and encoded as in
scoring. Every document is scored over its whole text in a projection without shuffle.

Defined cases: null and empty texts are one empty passage; labels that contradict each
other count as the lower one, null labels not at all; without labels every score is 0.5;
rows are scored one by one, repeated or not; of the rows of one id the one with the
smallest text hash is fitted; an empty table gives no rows; other columns are ignored. Ids
are integers, as everywhere in these tables; others are an error of the cast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import text as T

PASSAGE = 512
TRAIN_DOCS = 4000
TRAIN_BYTES = 32 << 20
TRAIN_TEXT = 4 << 20
FOLDS = 5
THRESHOLD = 0.3
HIDDEN, GATE = 24, 16
STEPS, RATE, DECAY = 250, 0.01, 1e-4
#: Bytes of text encoded at a time, a multiple of ``PASSAGE``.
SLICE = 1 << 20

CLASSES = 12


def _class_table() -> np.ndarray:
    """Character class of every byte."""
    table = np.full(256, 10, dtype=np.uint8)  # other signs
    table[ord("a"):ord("z") + 1] = 0
    table[ord("A"):ord("Z") + 1] = 1
    table[ord("0"):ord("9") + 1] = 2
    for group, chars in ((3, b" \t\r\v\f"), (4, b"\n"), (5, b"."), (6, b","), (7, b"!?"), (8, b"|"), (9, b"#*$%&<>")):
        table[list(chars)] = group
    table[128:] = 11
    return table


CLASS = _class_table()
SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
#: Random odd multipliers for word hashes, drawn from a fixed seed.
BYTE_HASH = np.where(SPACE, np.uint64(0), np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64))
PLACE_HASH = np.random.default_rng(2).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
WIDTH = CLASSES * CLASSES + 4


def encode(slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some slices, and the slice of each passage.

    A slice is a document, or a part of one that starts at a passage.
    """
    lengths = np.array([len(s) for s in slices])
    per = np.maximum(1, -(-lengths // PASSAGE))
    owner = np.repeat(np.arange(len(slices)), per)
    n = len(owner)
    within = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
    size = np.clip(lengths[owner] - within * PASSAGE, 0, PASSAGE)
    data = np.frombuffer(b"".join(slices), dtype=np.uint8)
    passage = np.repeat(np.arange(n), size)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if len(data):
        kind = CLASS[data].astype(np.int64)
        inside = owner[passage[1:]] == owner[passage[:-1]]
        pair = (passage[:-1] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[inside]
        out[:, :CLASSES * CLASSES] = np.bincount(pair, minlength=n * CLASSES * CLASSES).reshape(n, -1)
        space = SPACE[data]
        first = np.concatenate([[True], owner[passage[1:]] != owner[passage[:-1]]])
        begin = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | first))
        if len(begin):
            place = np.minimum(np.arange(len(data)) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(data)]]))), 63)
            with np.errstate(over="ignore"):
                word = np.add.reduceat(BYTE_HASH[data] * PLACE_HASH[place], begin)
            home = passage[begin]
            for lag in (1, 2):
                equal = (word[lag:] == word[:-lag]) & (owner[home[lag:]] == owner[home[:-lag]])
                out[:, -lag] = np.bincount(home[lag:][equal], minlength=n) * 6
            out[:, -3] = np.bincount(home, minlength=n)
    out /= np.maximum(size, 1)[:, None]
    out[:, -4] = np.log1p(size) / 8
    return out, owner


@dataclass
class Model:
    """Fitted parameters; their size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None

    def embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representation and attention logit of passages."""
        w = self.weights
        e = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w["W"] + w["b"])
        gated = np.tanh(e @ w["V"]) / (1 + np.exp(-(e @ w["U"])))
        return e, gated @ w["a"]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for every text."""
        if self.weights is None:
            return np.full(len(texts), 0.5)
        total, weight = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts))
        for slices, owners in _pieces(texts):
            x, owner = encode(slices)
            e, logit = self.embed(x)
            attention = np.exp(logit.astype(np.float64))
            docs = np.asarray(owners)[owner]
            np.add.at(weight, docs, attention)
            np.add.at(total, docs, e * attention[:, None])
        z = total / weight[:, None]
        return 1 / (1 + np.exp(-(z @ self.weights["c"] + self.weights["c0"][0])))


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Slices of about ``SLICE`` bytes in all, with the index of each one's text."""
    slices, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), SLICE):
            part = text[at:at + SLICE]
            if size + len(part) > SLICE and slices:
                yield slices, owners
                slices, owners, size = [], [], 0
            slices.append(part)
            owners.append(i)
            size += len(part)
    if slices:
        yield slices, owners


def features(text: bytes) -> np.ndarray:
    """Features of all passages of one text, as they are scored."""
    return np.concatenate([encode(slices)[0] for slices, _ in _pieces([text])])


def train(x: np.ndarray, owner: np.ndarray, label: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam on the log loss of documents. ``owner`` is sorted; one label per document."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6).astype(np.float32)
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in (
        ("W", (WIDTH, HIDDEN)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE)), ("a", (GATE,)), ("c", (HIDDEN,)))}
    w |= {"b": np.zeros(HIDDEN, np.float32), "c0": np.zeros(1, np.float32)}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(owner))))
    y = label.astype(np.float32)
    for step in range(1, STEPS + 1):
        e = np.tanh(z @ w["W"] + w["b"])
        t, g = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-(e @ w["U"])))
        tg = t * g
        k = np.exp(tg @ w["a"])
        k = k / np.add.reduceat(k, starts)[doc]
        bag = np.add.reduceat(e * k[:, None], starts, axis=0)
        p = 1 / (1 + np.exp(-(bag @ w["c"] + w["c0"])))
        d_logit = (p - y) / len(y)
        d_bag = d_logit[:, None] * w["c"]
        d_k = (e * d_bag[doc]).sum(axis=1)
        d_att = k * (d_k - np.add.reduceat(k * d_k, starts)[doc])
        d_tg = d_att[:, None] * w["a"]
        d_v, d_u = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_e = k[:, None] * d_bag[doc] + d_v @ w["V"].T + d_u @ w["U"].T
        d_h = d_e * (1 - e * e)
        grads = {"c": bag.T @ d_logit, "c0": d_logit.sum(keepdims=True), "a": tg.T @ d_att, "V": e.T @ d_v, "U": e.T @ d_u,
                 "W": z.T @ d_h, "b": d_h.sum(axis=0)}
        for name, grad in grads.items():
            grad = grad + DECAY * w[name]
            first[name] = 0.9 * first[name] + 0.1 * grad
            second[name] = 0.999 * second[name] + 0.001 * grad * grad
            w[name] = w[name] - RATE * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        folds: int = FOLDS, docs: int = TRAIN_DOCS, total: int = TRAIN_BYTES, longest: int = TRAIN_TEXT) -> Model:
    """Fit on labelled documents outside fold 0 of ``folds``."""
    known = T.pick(labels, doc_id="doc_id", label=label).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).filter(T.fold(F.col("doc_id"), folds) != 0)
    known = known.select(F.col("doc_id").cast("long").alias("l_id"), F.col("label").cast("int").alias("label"))
    rows = T.pick(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    sizes = rows.groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).filter(F.col("size") <= longest)
    drawn = sizes.join(known, F.col("doc_id") == F.col("l_id")).select("l_id", "label", "size", F.xxhash64("l_id").alias("place"))
    drawn = drawn.orderBy("place", "l_id").limit(docs)
    running = Window.orderBy("place", "l_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = drawn.withColumn("so_far", F.sum("size").over(running)).filter(F.col("so_far") <= total).select("l_id", "label")
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    of_one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("nth", F.row_number().over(of_one)).filter("nth = 1").select("doc_id", "label", "text")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for identity, y, value in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                data = (value or "").encode("utf-8", "surrogatepass")
                out.append((identity, y, features(data).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["doc_id", "label", "x"])

    found = rows.mapInArrow(passages, "doc_id long, label int, x binary").collect()
    found = sorted(found, key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not found:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), None)
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in found]
    owner = np.repeat(np.arange(len(x)), [len(v) for v in x])
    return train(np.concatenate(x), owner, np.array([r["label"] for r in found]))


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS,
          threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row."""
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (T.fold(F.col(f"`{doc_id}`"), folds) == 0).alias("held_out"), F.col(f"`{text}`").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score_texts(model, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """Scores of an Arrow column of texts, some thousand texts at a time."""
    scores = [np.zeros(0)]
    for at in range(0, len(column), 2048):
        texts = [(v or "").encode("utf-8", "surrogatepass") for v in column.slice(at, 2048).to_pylist()]
        scores.append(model.score(texts))
    return np.concatenate(scores)


def keep_good(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score_texts(model, batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array(values >= threshold))

    return documents.mapInArrow(judge, documents.schema)
