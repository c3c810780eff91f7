"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes cuts a text where its top bits are zero, with a strict mask before the normal
chunk size and a loose one after it, so that an edit moves only the cuts near it. A fingerprint is the set of
chunk digests, each weighted by its chunk's length; likeness is the weight that two sets share over the smaller
set's weight (containment).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.llm import hashing
from roadweft.llm.common import partitions, range_bounds, range_of

LEAST, NORMAL, MOST = 16, 64, 256
#: Zero bits wanted of the gear hash before and after the normal size.
STRICT, LOOSE = 8, 4
GEAR = (hashing.fmix(np.arange(1, 257, dtype=np.uint64) * hashing.WINDOW_BASE) >> np.uint64(32)).astype(np.uint32)
#: Stands for a null id: after all others in descending order.
NO_ID = -(1 << 63)


def gear(raw: bytes) -> np.ndarray:
    """The sum of gear[b] << age over the last 32 bytes, at each byte."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k) if len(h) > k else 0
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    n, h = len(raw), gear(raw)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = (loose[h[loose] >> np.uint32(32 - STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    out, at = [], 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] < at + NORMAL:
            at = strict[i]
        else:
            i = bisect_left(loose, at + NORMAL)
            at = min(loose[i] if i < len(loose) else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_set(raw: bytes) -> dict[int, int]:
    """Length of each distinct chunk by its 48-bit digest."""
    out, at = {}, 0
    for end in cuts(raw):
        out[xxhash.xxh3_64_intdigest(raw[at:end]) >> 16] = end - at
        at = end
    return out


def written(chunks: dict[int, int]) -> str:
    """The fingerprint as text: 12 hex digits of the digest and 3 of the length of each chunk, in order of digest."""
    return "".join([f"{d:012x}{n:03x}" for d, n in sorted(chunks.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared weight over the smaller weight; two empty texts are alike, an empty and another are not."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(n for d, n in small.items() if d in large)
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, after: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def _fingerprints(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    for batch in batches:
        rows = []
        for part, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text")), strict=True):
            text = text or ""
            chunks = chunk_set(text.encode())
            if held and held[0] == part and not held[1]:
                _, _, old_id, old, old_chunks = held
                new = edited(old, text).encode()
                new_chunks = chunk_set(new)
                rows.append((old_id, len(old), hashlib.sha256(new).hexdigest(), written(old_chunks), written(new_chunks), likeness(old_chunks, new_chunks), likeness(old_chunks, chunks)))
            held = (part, copy, doc_id, text, chunks)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)


def fingerprint_neighbours(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) with its fingerprint, that of its edited text, and their likeness.

    The edited text has its last third of code points replaced by the first ones of the next document in
    descending doc_id; the first follows the last. Null text is empty. Null ids come after all others; rows
    that repeat an id are one range, and follow each other in the order of their texts. The rows are dealt once,
    each range of ids to a task of its own; each range also gets a copy of the row that follows it, so no rows are joined.
    """
    names = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    docs = docs.select(*names)
    top = docs.agg(F.max("key")).first()[0]
    edges = sorted({*range_bounds(docs, F.col("key"), n or partitions(docs.sparkSession)), NO_ID if top is None else top})
    # the first row of range p follows the last of range p + 1, and that of the last range closes the ring
    to = lambda part, copy: F.struct(part.cast("int").alias("part"), F.lit(copy).alias("copy"))
    part = F.col("p")
    first = F.get(F.array(*map(F.lit, edges)), part) == F.col("key")
    both = F.when(first, F.array(to(part, 0), to((part + 1) % len(edges), 1))).otherwise(F.array(to(part, 0)))
    dealt = docs.withColumn("p", range_of(F.col("key"), edges)).select("key", "doc_id", "text", F.inline(both))
    dealt = dealt.repartitionById(len(edges), "part").sortWithinPartitions("part", "copy", F.desc("key"), "text")
    return dealt.mapInArrow(_fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
