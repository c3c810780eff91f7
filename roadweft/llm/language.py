"""Language identification by nearest centroids.

Vectors are hashed byte n-grams of lower-cased letters, square roots of counts times IDF, of length 1. Document
frequencies come from all training documents; the centroids, several per language from spherical k-means, from
a bounded sample of them. A text gets the language of the centroid with the largest cosine; texts far from all
centroids are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from roadweft.llm.common import lean

DIMS, GRAMS = 8192, (1, 2, 3)
#: Documents of a language that k-means sees at most, centroids of a language, and rounds.
SAMPLE, CENTROIDS, ROUNDS = 400, 3, 8
#: A text is rejected below this part of the lowest hundredth of the sample's own cosines.
REJECT = 0.4
UNKNOWN = "und"
KEEP = np.full(256, 32, np.uint8)
KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
KEEP[128:] = np.arange(128, 256)


def counts(text: str) -> np.ndarray:
    """Occurrences of each hashed n-gram in one text."""
    a = KEEP[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])].astype(np.uint32)
    out = np.zeros(DIMS, np.int64)
    code = a
    for n in GRAMS:
        if n > 1:
            code = code[:-1] * np.uint32(257) + a[n - 1 :] if len(code) > 1 else code[:0]
        out += np.bincount(((code * np.uint32(2654435761)) ^ np.uint32(n * 40503)) >> np.uint32(19), minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.empty((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        out[i] = counts(t)
    np.sqrt(out, out=out)
    out *= idf
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    least: float


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode's category L."""
    return text is not None and any(map(str.isalpha, text))


def k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from far-apart starts; rows of length 1."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _frequencies(batches):
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                total += counts(text) > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS, dtype=np.int32)), pa.array(np.concatenate([[n], total]))], names=["i", "df"])


def fit(train: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> Model:
    """A model of training rows (doc_id, text, lang) with non-null lang.

    sample is the bound on documents of a language that are gathered for its centroids: those with the smallest
    hashes of id and text, repeated rows once. An empty training table gives a model that calls everything unknown.
    """
    train = train.where("lang is not null and text is not null")
    df = np.ones(DIMS)
    n = 1
    for i, v in train.select("text").mapInArrow(lean(_frequencies), "i int, df long").groupBy("i").agg(F.sum("df")).collect():  # DIMS + 1 rows
        if i < 0:
            n = max(v, 1)
        else:
            df[i] = v
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    per = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row for each language
    if not per:
        return Model([], idf, np.zeros((0, DIMS), np.float32), 0.0)
    # about a half more than wanted, cut to the least hashes
    share = F.element_at(F.create_map(*(F.lit(x) for lang, c in per.items() for x in (lang, min(1.0, 1.5 * sample / c)))), F.col("lang"))
    drawn = train.withColumn("point", F.xxhash64("doc_id", "text")).where(F.pmod("point", F.lit(1 << 30)) / float(1 << 30) < share)
    drawn = drawn.groupBy("lang", "point").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("point", F.lit(1 << 30)), "point"))
    rows = drawn.withColumn("r", rank).where(F.col("r") <= sample).select("lang", "text").collect()
    langs, cents, own = [], [], []
    for lang in sorted(per):
        texts = [r["text"] for r in rows if r["lang"] == lang and has_letter(r["text"])]
        if texts:
            x = vectors(texts, idf)
            c = k_means(x, centroids, rounds)
            langs += [lang] * len(c)
            cents.append(c)
            own.append((x @ c.T).max(axis=1))
    if not langs:
        return Model([], idf, np.zeros((0, DIMS), np.float32), 0.0)
    return Model(langs, idf, np.concatenate(cents), REJECT * float(np.quantile(np.concatenate(own), 0.01)))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (largest cosine, 0 to 1) and rejected; columns of those names are replaced.

    Null texts and texts without a letter: 'und', score 0, rejected. Equal cosines: the first language by name.
    """
    docs = docs.drop("lang_pred", "score", "rejected")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
            for lo in range(0, len(rows), 128):
                part = rows[lo : lo + 128]
                near = vectors([texts[i] for i in part], model.idf) @ model.centroids.T
                best = near.argmax(axis=1)
                for i, b, v in zip(part, best.tolist(), near.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = model.langs[b], min(max(v, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array([x == UNKNOWN or s < model.least for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(lean(run), schema)


def held_out():
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents: doc_id, held_out, lang_pred, score, rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected; the model is learned from their own rows."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.select("text", *(F.col(c).alias(n) for c, n in names.items()))
    kept = classify(renamed, model).where("not rejected")
    return kept.select(*(F.col("text") if c == "text" else F.col(names[c]).alias(c) for c in docs.columns))
