"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

The texts of a bounded sample of labelled rows (SAMPLE, those with the least hash of doc_id)
train one model: per-coordinate learning rates, L1 for sparsity, L2. What remains of it is a
short list of (bucket, weight), at most 2**BITS of them, which goes to all tasks. Scoring is
whole-array work on the bytes of a batch. Scores see the text only.

Defined results: null and empty texts have no features and score by the bias alone; rows with
a null doc_id are never trained on; without labelled training rows the score is 0; a label given
several times counts as toxic if any says so; repeated documents score alike; a score of exactly 0.7 counts as toxic; the
sample's ties in the hash go by doc_id; accepted() carries extra columns and may clash with no name but _toxicity, report() ignores them; an empty
table gives no rows. A text is scored whole in one task, with about 120 bytes of memory for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bytes, columns, encoded, free, mixed, pieces

BITS, SAMPLE, EPOCHS, CUT = 20, 12_000, 6, 0.7
#: Strong L1 leaves a few hundred weights; toxic rows are few and count POSITIVE times.
ALPHA, BETA, L1, L2, POSITIVE = 4.0, 1.0, 10.0, 0.01, 4.0


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a batch's texts, each once a text, and where each text's buckets start.

    Words are letters, digits and other bytes between ASCII spaces and punctuation, lower case:
    the hashes of words, of neighbouring words and of words with one between them.
    """
    plain = [t.translate(_TO_SPACES) for t in texts]
    b = Bytes(plain, lower=True)
    s, e, doc = b.words()
    h = b.hashed(s, e)
    grams, owner = [h], [doc]
    for gap, salt in ((1, 0x5BD1E995), (2, 0x1B873593)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            grams.append(mixed(h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(salt))[same])
            owner.append(doc[gap:][same])
    bucket = np.concatenate(grams) & np.uint64((1 << bits) - 1)
    both = np.unique((np.concatenate(owner).astype(np.uint64) << np.uint64(bits)) | bucket)
    starts = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(bits))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), starts


_TO_SPACES = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


class Ftrl:
    """FTRL-proximal; weights come from z and n when they are needed."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        free = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -free / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: float, weight: float = 1.0) -> float:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = (p - y) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def learned(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a weight, and the weights; the last bucket, past all others, is the bias."""
    model, order = Ftrl(), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, y = rows[i]
            model.learn(at, y, POSITIVE if y else 1.0)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at]


def sample(docs: DataFrame, labels: DataFrame, held_out: F.Column, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most `size` labelled rows outside the held-out ones."""
    y = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = y.filter(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # the limit bounds it


def train(docs: DataFrame, labels: DataFrame, held_out: F.Column, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash the sample's texts where they are; one task gathers the buckets and learns."""

    def hashed(batches):
        for b in pieces(batches):
            at, starts = features(encoded(b.column("text")))
            packed = [at[s:e].astype(np.int32).tobytes() for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "at": pa.array(packed, pa.binary())})

    def fit(batches):
        rows = [x for b in batches for x in zip(*(b.column(k).to_pylist() for k in ("doc_id", "at", "toxic")), strict=True)]
        rows.sort()
        at, w = learned([(np.frombuffer(x, np.int32), y) for _, x, y in rows])
        yield pa.record_batch({"at": pa.array(at.astype(np.int64)), "w": pa.array(w)})

    buckets = sample(docs, labels, held_out, size).mapInArrow(hashed, "doc_id long, toxic int, at binary")
    found = buckets.repartition(1).mapInArrow(fit, "at long, w double").toArrow()
    return found.column("at").to_numpy(), found.column("w").to_numpy()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in column `name`; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS + 1 weights
    none = not len(model[0])

    def run(batches):
        dense = np.zeros((1 << BITS) + 1)
        dense[shared.value[0]] = shared.value[1]
        for b in batches:
            scores = []
            for part in pieces([b]):
                texts = encoded(part.column("text"))
                bucket, starts = features(texts)
                total = np.concatenate([[0.0], np.cumsum(dense[bucket])])
                z = total[starts[1:]] - total[starts[:-1]] + dense[-1]
                scores.append(np.zeros(len(texts)) if none else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*scores, np.zeros(0)]))], names=[*b.schema.names, name])

    # by plain names on the way through Python, as Spark looks columns up by name there
    plain = docs.toDF(*[c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())])).toDF(*docs.columns, name)


def held_out_rows() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = held_out_rows()
    model = train(docs, labels, held)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    model = train(docs, labels, held_out_rows())
    name = free(docs, "toxicity")
    return scored(docs, model, name).filter(F.col(name) < CUT).select(*columns(docs))
