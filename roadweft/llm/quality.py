"""Quality classification by positive-unlabelled learning.

Trusted positives are the labelled good documents, the unlabelled set is a sample of the corpus, and the class
prior is estimated. A small network on shape features minimises the non-negative unbiased risk:
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), with the sigmoid loss; where the second
part falls below zero its gradient is turned round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.llm import hashing
from roadweft.llm.common import chunks, text_bytes

#: Documents of either set that are gathered for training at most.
SAMPLE = 8000
HIDDEN, ROUNDS, RATE, SEED = 24, 400, 0.02, 7
THRESHOLD = 0.3
#: Bytes counted as groups.
GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "bang": b"!?", "pipe": b"|", "symbol": b"#$%&*@^~_=+<>\\/{}[]", "high": range(128, 256), "line": b"\n"}
CLASS = np.zeros(256, np.int64)
for _i, _g in enumerate(GROUPS.values()):
    CLASS[list(_g)] = _i + 1
N_FEATURES = len(GROUPS) + 14


def shape(raw: bytes, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of one text from its bytes, word hashes and word lengths."""
    out = np.zeros(N_FEATURES, np.float64)
    n, w = len(raw), len(words)
    if not w:
        return out
    a = np.frombuffer(raw, np.uint8)
    groups = np.bincount(CLASS[a], minlength=len(GROUPS) + 1)[1:] / n
    k = len(GROUPS)
    out[:k] = np.sqrt(groups)
    _, times = np.unique(words, return_counts=True)
    share = times / w
    out[k] = np.log1p(w) / 10
    out[k + 1] = len(times) / w
    out[k + 2] = share.max()
    out[k + 3] = -(share * np.log(share)).sum() / max(np.log(w), 1.0)
    out[k + 4] = (words[1:] == words[:-1]).mean() if w > 1 else 0
    three = hashing.shingles(words, 3)
    out[k + 5] = 1 - len(np.unique(three)) / len(three)
    out[k + 6] = lengths.mean() / 10
    out[k + 7] = lengths.std() / 10
    out[k + 8] = (lengths <= 3).mean()
    out[k + 9] = (lengths == 1).mean()
    byte = np.bincount(a, minlength=256) / n
    byte = byte[byte > 0]
    out[k + 10] = -(byte * np.log(byte)).sum() / 4
    rows = raw.split(b"\n")
    out[k + 11] = 1 - len(set(rows)) / len(rows)
    out[k + 12] = np.log1p(n / len(rows)) / 8
    ends = np.array([r.rstrip()[-1:] in (b".", b"!", b"?", b":") for r in rows])
    out[k + 13] = ends.mean()
    return out


def features(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for lo, hi in chunks(texts):
        hashes, first, starts, ends = hashing.words(texts[lo:hi])
        for i in range(lo, hi):
            a, b = first[i - lo], first[i - lo + 1]
            out[i] = shape(texts[i], hashes[a:b], ends[a:b] - starts[a:b])
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> Network:
    """Minimise the non-negative risk with Adam over whole samples."""
    rng = np.random.default_rng(SEED)
    everything = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    par = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]

    def forward(x):
        h = np.tanh(x @ par[0] + par[1])
        return h, 1 / (1 + np.exp(-np.clip(h @ par[2] + par[3], -30, 30)))

    def backward(x, h, slope):
        back = slope[:, None] * par[2] * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]

    for t in range(1, rounds + 1):
        (hp, sp), (hu, su) = forward(p), forward(u)
        # sigmoid loss: 1 - s for a positive, s for a negative
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            grads = zip(backward(p, hp, -2 * prior * dp), backward(u, hu, du), strict=True)
        else:
            grads = zip(backward(p, hp, prior * dp), backward(u, hu, -du), strict=True)
        for i, (a, b) in enumerate(grads):
            g = a + b + 1e-4 * par[i] * (i in (0, 2))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            par[i] = par[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, par[0], par[1], par[2], float(par[3][0]))


def held_out():
    """Whether a document's label is kept from training; that of a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array([x.tobytes() for x in features(text_bytes(batch.column("text")))], pa.binary())], names=["good", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from docs (doc_id, text) and labels (doc_id, quality); None if there is nothing to learn from.

    The positives are labelled 1 outside the held-out ids, the unlabelled rows any documents outside them.
    sample bounds the rows of either set that are gathered: those with the smallest hashes, repeated rows once. The
    prior is the share of 1 among all labels outside the held-out ids, with one more of each class.
    Null labels and ids are no labels.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n, good = known.agg(F.count("*"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    rest = docs.where(~held_out()).select("doc_id", "text")
    n_docs = rest.count()
    if not good or not n_docs:
        return None
    prior = (good + 1) / (n + 2)
    point = F.xxhash64(F.lit(SEED), "doc_id", "text")
    # about a half more than wanted, cut to the least hashes
    drawn = lambda df, count: df.withColumn("point", point).where(F.pmod("point", F.lit(1 << 30)) / float(1 << 30) < 1.5 * sample / count)
    pos = drawn(rest.join(known.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"), good).select(F.lit(True).alias("good"), "point", "text")
    unl = drawn(rest, n_docs).select(F.lit(False).alias("good"), "point", "text")
    both = pos.unionByName(unl).groupBy("good", "point").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("good").orderBy(F.pmod("point", F.lit(1 << 30)), "point"))
    rows = both.withColumn("r", rank).where(F.col("r") <= sample).select("good", "text").mapInArrow(_vectors, "good boolean, x binary").collect()
    sides = [np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["good"] is g]) for g in (True, False)]
    if not len(sides[0]) or not len(sides[1]):
        return None
    return train(*sides, prior)


def classify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, score, predicted) of docs (doc_id, text). Null and empty texts are scored as texts without words; without a network every score is 0.5."""

    def run(batches):
        for batch in batches:
            x = features(text_bytes(batch.column("text")))
            s = network.score(x) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s.astype(np.float64)), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
