"""Token-id output as Parquet list columns.

Documents are range partitioned by id, encoded, and written by Spark's Parquet writer with dictionary encoding
for the ids, delta encoding for the rest (format version 2), bounded row groups and pages, and page indexes
(which that writer always adds), so that readers can pick documents by id and columns by name. A file's rows
carry the ids before them in the same range; the starts of the ranges are summed from one row a range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.llm.common import chunks, fresh_path, offsets_list, partitions, range_bounds, range_of, text_bytes
from roadweft.llm.tokens import encoder, vocabulary

VOCABULARY, END = "byte_bpe_50k.json", 2
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 1000
#: Ranges whose bases are broadcast: 16 bytes each.
MOST_RANGES = 1 << 20
SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def _encode(path: str, end: int, special_as_text: bool):
    def run(batches):
        model, part, before = encoder(path, True, special_as_text), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id")
            for lo, hi in chunks(texts, 4_000_000):
                tokens = [np.append(x, np.uint32(end)) for x in model.encode(texts[lo:hi])]
                size = np.array([len(x) for x in tokens], np.int64)
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + ends - size), pa.array(size), offsets_list(pa.array(np.concatenate(tokens).view(np.int32)), np.concatenate([[0], ends]).astype(np.int32))],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None, end: int = END, n: int | None = None, special_as_text: bool = False) -> None:
    """Write (doc_id, part, before, n_tokens, ids) of docs (doc_id, text) in ascending doc_id order, files named in that order.

    A document's ids end with the end id, so an empty or null text has that one id. Null doc_ids come first;
    rows that repeat an id are one range, and follow each other in the order of their texts. Ids are unsigned
    values below 2**31. A special token's string in a text becomes its id, as in the library, or ordinary text on demand.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = range_bounds(docs, F.col("doc_id"), n or partitions(docs.sparkSession))
    docs = docs.repartitionById(len(bounds) + 1, range_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id", "text")
    tokens = docs.mapInArrow(_encode(vocabulary_path or vocabulary(VOCABULARY), end, special_as_text), SCHEMA)
    options = {
        "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.column.index.truncate.length": 16, "compression": "zstd",
    }
    tokens.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark, path: str, columns: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the files with start, the ids before each document in the whole corpus; only what is asked for is read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    ranges = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each range that was written
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    if low is not None:
        files = files.where(F.col("doc_id") >= low)
    if high is not None:
        files = files.where(F.col("doc_id") <= high)
    # a row a range: broadcast while they are few, or each shuffle would move all ids
    ranges = F.broadcast(ranges) if ranges.count() <= MOST_RANGES else ranges
    out = files.join(ranges, "part").withColumn("start", F.col("base") + F.col("before"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8).data
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: doc_id, start, n_tokens, ids_crc32."""
    path = fresh_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
