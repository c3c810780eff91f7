"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Every window of every text is hashed from prefix sums. A window can only repeat if its anchor, the smallest
hash among its short sub-windows, repeats as well; equal windows have equal anchors, so windows whose anchor
lies in one document alone are settled without a shuffle. The rest is counted by window hash, with the smallest
document id, and the windows that an earlier document has are merged into maximal intervals.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweft.llm import hashing
from roadweft.llm.common import chunks, lean, stage, text_bytes

WIDTH, ANCHOR = 50, 8


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of span values, by doubling."""
    done = 1
    while done < span:
        step = min(done, span - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(hashes: np.ndarray, width: int, short: int) -> np.ndarray:
    """The anchor of each window of one text."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    return sliding_min(hashing.windows(hashes, short), width - short + 1)


def covered(starts: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the starts."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [lo, hi) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _per_text(batch):
    texts = text_bytes(batch.column("text"))
    for lo, hi in chunks(texts):
        hashes, first, starts, ends = hashing.words(texts[lo:hi])
        base = np.cumsum([0] + [len(x) + 1 for x in texts[lo:hi]])
        for i, (a, b) in enumerate(itertools.pairwise(first)):
            yield lo + i, texts[lo + i], hashes[a:b], starts[a:b] - base[i], ends[a:b] - base[i]


def _long_rows(batch, rows: list[int], values: list[np.ndarray], name: str):
    size = [len(v) for v in values]
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], size), pa.int64()), pa.array(flat)], names=["doc_id", name])


def _anchor_rows(width: int, short: int):
    def run(batches):
        for batch in batches:
            rows, values = [], []
            for i, _, hashes, _, _ in _per_text(batch):
                found = np.unique(anchors(hashes, width, short))
                if len(found):
                    rows.append(i)
                    values.append(found)
            yield _long_rows(batch, rows, values, "anchor")

    return run


def _window_rows(width: int, short: int):
    def run(batches):
        for batch in batches:
            known, rows, values = batch.column("anchors"), [], []
            for i, _, hashes, _, _ in _per_text(batch):
                near = np.isin(anchors(hashes, width, short), known[i].values.to_numpy().view(np.uint64))
                found = np.unique(hashing.windows(hashes, width)[near])
                if len(found):
                    rows.append(i)
                    values.append(found)
            yield _long_rows(batch, rows, values, "w")

    return run


def _cut(width: int):
    """Adds n_words, the removed word intervals and the kept words to each row."""

    def run(batches):
        for batch in batches:
            known = batch.column("ws")
            n, gone, spans, kept = [], [], [], []
            for i, text, hashes, starts, ends in _per_text(batch):
                n.append(len(hashes))
                mask = np.zeros(len(hashes), bool)
                if known[i].is_valid and len(hashes) >= width:
                    bad = np.flatnonzero(np.isin(hashing.windows(hashes, width), known[i].values.to_numpy().view(np.uint64)))
                    mask = covered(bad, len(hashes), width)
                runs = intervals(mask)
                gone.append(int(mask.sum()))
                spans.append([{"start": a, "end": b} for a, b in runs])
                if not runs:
                    kept.append(b" ".join(text.split()).decode())
                    continue
                at, parts = 0, []
                for a, b in [*runs, (len(hashes), len(hashes))]:
                    if a > at:
                        parts += text[starts[at] : ends[a - 1]].split()
                    at = b
                kept.append(b" ".join(parts).decode())
            columns = [c for c in batch.schema.names if c not in ("ws",)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                names=[*columns, "n_words", "n_removed", "removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, short: int = ANCHOR) -> DataFrame:
    """docs with n_words, n_removed, removed intervals of word positions, and kept words joined by a space; other columns of those names are replaced.

    A word is removed if it lies in a window of width words that also starts in a document with a smaller
    doc_id, judged on the input. Null or empty text: no words, nothing removed, kept is ''. A null id: it is
    smaller than nothing and has nothing smaller, so its text stays whole and removes nothing. Rows that
    repeat an id are each cut against smaller ids, never against each other.
    """
    made = T.StructType.fromDDL("n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
    extra = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", *made.names)}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(n) for c, n in extra.items()))
    named = docs.where("doc_id is not null").select("doc_id", "text")
    found = named.mapInArrow(lean(_anchor_rows(width, short)), "doc_id long, anchor long")
    many = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    per = found.join(many, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    windows = named.join(per, "doc_id").select("doc_id", "text", "anchors").mapInArrow(lean(_window_rows(width, short)), "doc_id long, w long")
    windows = stage(windows, "substring-windows")
    counted = windows.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w", "lo")
    bad = windows.join(counted, "w").where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("w").alias("ws"))
    out = docs.join(bad, "doc_id", "left").select(*docs.columns, "ws").mapInArrow(lean(_cut(width)), T.StructType([*docs.schema.fields, *made.fields]))
    return out.select("doc_id", "text", *(F.col(n).alias(c) for c, n in extra.items()), *made.names)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 50-word windows over all documents: doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated windows cut out of text; texts that lose nothing stay as they are, n_chars follows the text. Other columns may have any names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rest = [F.col(c).alias(n) for c, n in names.items() if c not in ("doc_id", "text")]
    cut = remove_repeats(docs.select("doc_id", "text", *rest), width)
    new = {c: F.col(n) for c, n in names.items() if c not in ("doc_id", "text")}
    new |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col(names["n_chars"]))
    return cut.select(*(new[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS lo FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM w JOIN f USING (h) WHERE lo < doc_id),
every AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
