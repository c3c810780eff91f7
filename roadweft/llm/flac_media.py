"""Media columns in FLAC: texts' bytes as 8-bit samples, and blocks of samples that can be sought.

The codec is in flac.py. Streams live in a binary column; each is at most a little larger than its payload.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.llm import flac
from roadweft.llm.common import CHUNK_BYTES, chunks, text_bytes

UNIT = 64


def padded(raw: bytes) -> bytes:
    """raw and bytes 0 up to a positive multiple of UNIT."""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def feature(payload: bytes) -> str:
    """Level, spread, turns and zero crossings of the samples, as fixed text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = len(x)
    step = np.diff(x)
    crossings = int((np.diff(x >= 0)).sum())
    return f"n={n};mean={x.sum() / n:.6f};rms={(int((x * x).sum()) / n) ** 0.5:.6f};step={np.abs(step).sum() / n:.6f};zero={crossings};peak={int(np.abs(x).max())}"


def encode_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (of the text) and media (its FLAC stream); null text is empty. Columns of those names are replaced."""
    docs = docs.drop("n_bytes", "media")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(text_col))
            for lo, hi in chunks(texts, CHUNK_BYTES):
                media = flac.encode([padded(t) for t in texts[lo:hi]])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array(media, pa.binary())], names=[*part.schema.names, "n_bytes", "media"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored stream's samples and seek table show; a stream with a wrong checksum fails the job. Null media gives nulls.

    blocks is the number of PCM blocks that can be sought, last_sample where the last one begins; null without a seek table.
    """

    def run(batches):
        for batch in batches:
            raw = batch.column("media").to_pylist()
            for lo, hi in chunks([r or b"" for r in raw], CHUNK_BYTES):
                part, streams = batch.slice(lo, hi - lo), raw[lo:hi]
                there = iter(flac.decode([s for s in streams if s is not None]))
                payloads = [None if s is None else next(there) for s in streams]
                points = [None if s is None else flac.parse_stream(s).points for s in streams]
                cols = [
                    (pa.int64(), [None if p is None else len(p) for p in payloads]),
                    (pa.string(), [None if p is None else hashlib.sha256(p).hexdigest() for p in payloads]),
                    (pa.int64(), [None if p is None else zlib.crc32(p[-UNIT:]) for p in payloads]),
                    (pa.int64(), [None if s is None else len(s) for s in streams]),
                    (pa.string(), [None if s is None else hashlib.sha256(s).hexdigest() for s in streams]),
                    (pa.string(), [None if p is None else feature(p) for p in payloads]),
                    (pa.int64(), [None if p is None else len(p) for p in points]),
                    (pa.int64(), [None if p is None else int(p["sample"][-1]) for p in points]),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(v, k) for k, v in cols)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks", "last_sample"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks long, last_sample long")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample (offset of the block's first), byte (offset in the audio part), n, pcm: every frame of every stream, decoded.

    Null media and streams without a seek table have no blocks. Rows that repeat an id have theirs each.
    """

    def run(batches):
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if raw is None:
                    continue
                payload, points = flac.decode([raw])[0], flac.parse_stream(raw).points
                if points is None:
                    continue
                rows = [(doc_id, i, int(p["sample"]), int(p["byte"]), int(p["n"]), payload[int(p["sample"]) : int(p["sample"]) + int(p["n"])]) for i, p in enumerate(points)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=["doc_id", "block", "sample", "byte", "n", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample long, byte long, n long, pcm binary")


def op5_media_flac(spark, sf_dir: str) -> DataFrame:
    """All documents stored as FLAC, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read_media(encode_media(docs).select("doc_id", "n_bytes", "media"))
