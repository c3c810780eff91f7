"""Shared helpers of the training-data operators: staging, sessions, Arrow batches and the memory of worker processes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.llm import hashing
from roadweft.plans.staging import fresh_path, remove, shared_dir, stage

#: Bytes of text that a kernel looks at in one go; one longer text is taken alone.
CHUNK_BYTES = 1_000_000

__all__ = ["CHUNK_BYTES", "chunks", "fresh_path", "lean", "let_go", "offsets_list", "partitions", "range_bounds", "range_of", "remove", "shared_dir", "stage", "text_bytes", "worker_tables"]

_tables: list[dict] = []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(docs: DataFrame, key: Column, n: int) -> list[int]:
    """At most n - 1 ascending values of a whole-number key that part its rows into ranges of about equal count; nulls are left out.

    Only the key is read; what comes to the driver is n numbers.
    """
    found = docs.select(key.cast("long").alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [1.0], 20 * n)).first()[0]
    return sorted(set(found or [])) if n > 1 else []


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that lie below a key, by halving: the range that it belongs to. Null belongs to range 0."""
    if not bounds:
        return F.lit(0)
    places = F.array(*map(F.lit, bounds))
    powers = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    further = lambda at, p: (at + p <= len(bounds)) & (F.get(places, at + p - 1) < key)
    return F.when(key.isNull(), 0).otherwise(F.aggregate(powers, F.lit(0), lambda at, p: F.when(further(at, p), at + p).otherwise(at)))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null gives no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of texts that together hold at most limit bytes, or one text."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        if i > lo and size + len(x) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(x) + 1
    if lo < len(texts):
        yield lo, len(texts)


def worker_tables() -> dict:
    """A new dict that lasts as long as the worker process, until let_go() empties it."""
    _tables.append({})
    return _tables[-1]


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU library
        pass


def let_go() -> None:
    """Empties the tables that this process keeps between tasks and gives its free memory back to the system."""
    for table in _tables:
        table.clear()
    for powers in (hashing.BYTES, hashing.WORDS):
        powers.clear()
    pa.default_memory_pool().release_unused()
    _trim()


def lean(run: Callable) -> Callable:
    """A kernel of mapInArrow that keeps nothing between tasks.

    Spark runs the tasks of all operators in the same worker processes, so it also lets go of what an operator
    before it kept there.
    """

    def kernel(batches):
        let_go()
        yield from run(batches)
        let_go()

    return kernel


def offsets_list(values: pa.Array, offsets) -> pa.ListArray:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
