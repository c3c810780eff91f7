"""Hierarchical multi-length packing of token ids into sequences.

Documents are routed to context tiers by length; what exceeds the longest window is cut into full windows
first. Tiers are packed from the longest window down: a window takes a document of its tier, its gap takes the
longest documents of shorter tiers that fit, and a last cut piece fills what is left, its rest going back to a
shorter tier. The end of a block is cut into windows of falling powers of two, so no window is padded. Windows
are laid out by falling length into step groups of equal tokens.

Each task packs blocks of bounded size from its own documents, so packing needs no shuffle and a hot source
or a long document changes nothing; a task that runs again makes the same sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.llm.common import chunks, text_bytes
from roadweft.llm.tokens import encoder, vocabulary

VOCABULARY, END = "word_bpe_49k.json", 1
TIERS = (256, 512, 1024, 2048)
#: Tokens that a task packs at a time, and tokens of a step group.
BLOCK_TOKENS, STEP_TOKENS = 4_000_000, 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Shelf:
    """Pieces by exact length, with the longest that fits found from one bit mask."""

    def __init__(self, top: int):
        self.stacks: list[list] = [[] for _ in range(top + 1)]
        self.mask = 0

    def put(self, length: int, piece) -> None:
        if length:
            self.stacks[length].append(piece)
            self.mask |= 1 << length

    def take(self, most: int, least: int = 1):
        """(length, piece) of the longest piece of least to most tokens, or None."""
        found = (self.mask & ((2 << most) - 1)) >> least
        if not found:
            return None
        length = found.bit_length() - 1 + least
        piece = self.stacks[length].pop()
        if not self.stacks[length]:
            self.mask &= ~(1 << length)
        return length, piece


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(window length, [(document, start, length), ...]) for documents of the given sizes; every window is full."""
    top = tiers[-1]
    shelf, out = Shelf(top), []
    for d, size in reversed(list(enumerate(sizes))):
        full = size // top * top
        out += [(top, [(d, at, top)]) for at in range(0, full, top)]
        shelf.put(size - full, (d, full))
    for tier, shorter in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        while (found := shelf.take(tier, shorter + 1)) is not None:
            window, gap = [], tier
            while found is not None:
                length, (d, at) = found
                used = min(length, gap)
                window.append((d, at, used))
                gap -= used
                shelf.put(length - used, (d, at + used))
                if not gap:
                    break
                # the longest that fits, else a cut of the shortest tier that is left
                found = shelf.take(gap) or shelf.take(top)
            out += [(tier, window)] if not gap else tail(window)
    return out


def tail(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of falling powers of two from the last pieces."""
    out, left = [], sum(p[2] for p in pieces)
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            d, at, length = pieces.pop()
            used = min(length, gap)
            window.append((d, at, used))
            gap -= used
            if used < length:
                pieces.append((d, at + used, length - used))
        out.append((size, window))
        left -= size
    return out


def _pack(path: str, end: int, tiers: tuple[int, ...], block_tokens: int, step_tokens: int, special_as_text: bool):
    def emit(ids: list, tokens: list[np.ndarray], first: int):
        windows = sorted(pack([len(t) for t in tokens], tiers), key=lambda w: -w[0])
        raw = [memoryview(t.tobytes()) for t in tokens]
        cols: list[list] = [[] for _ in range(9)]
        laid = 0
        for i, (size, window) in enumerate(windows):
            at = 0
            for d, start, length in window:
                for c, v in zip(cols, (ids[d], start, length, zlib.crc32(raw[d][4 * start : 4 * (start + length)]), len(tokens[d]), first + i, at, size, (first << 8) + laid // step_tokens), strict=True):
                    c.append(v)
                at += length
            laid += size
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return len(windows), pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches):
        model, first = encoder(path, False, special_as_text), TaskContext.get().partitionId() << 32
        ids, tokens, held = [], [], 0
        for batch in batches:
            texts, names = text_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for lo, hi in chunks(texts, 2_000_000):
                for name, t in zip(names[lo:hi], model.encode(texts[lo:hi]), strict=True):
                    ids.append(name)
                    tokens.append(np.append(t, np.uint32(end)))
                    held += len(t) + 1
                    if held >= block_tokens:
                        n, out = emit(ids, tokens, first)
                        yield out
                        first, ids, tokens, held = first + n, [], [], 0
        if ids:
            yield emit(ids, tokens, first)[1]

    return run


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, end: int = END, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS, special_as_text: bool = False) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null or empty text has only the end id. Null and repeated doc_ids are packed like others: each row is a
    document. No windows are padded: those at a task's end have falling powers of two. A special token's string in
    a text becomes its id, as in the library, or ordinary text on demand.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_pack(vocabulary_path or vocabulary(VOCABULARY), end, tiers, block_tokens, step_tokens, special_as_text), SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row for each piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
