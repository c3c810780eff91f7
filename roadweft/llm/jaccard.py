"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles. Equal sets become one node first. A set can reach the wanted similarity
only if enough of its shingles occur in another set, so shingles that occur once are counted out exactly
(blocks of packed hashes, split by hash range); what remains is ordered by rarity, and only sets that share one
of their rarest shingles (the prefix that any similar pair must share) can meet. Those candidates form groups.

Within a group the join is made by signature trees: a node holds the OR of the bitmaps of its sets, their size
range and the largest number of shingles that share bits. A dual traversal drops pairs of nodes whose largest
possible overlap is below what their sizes need. A group of one block's size is one tree, met with itself. The
root level of larger groups works on the whole group: one pivot is met by all members, members linked to it need
no further pairing with each other, and the rest is dealt by size and least shingle into blocks whose root nodes
are paired and pruned before any pair of blocks is opened. Where that leaves many blocks, the group is dealt anew
by the rare shingles that its members share, and each of those smaller groups is joined in the same way.
Links found are a spanning set: no pair is tested once both of its sides are known to be connected.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.llm import hashing
from roadweft.llm.common import chunks, lean, remove, stage, text_bytes
from roadweft.operators.graph import components

WORDS, PERCENT = 5, 80
#: Shingles that one bucket of the occurrence count holds on average.
BUCKET = 2_000_000
#: Bytes of text whose shingles are packed together.
BLOCK_BYTES = 4_000_000
#: Sets in a block of the pair phase, and their shingles; sets in a leaf of a tree; nodes below a node.
BLOCK, BLOCK_SHINGLES, LEAF, FAN = 256, 2_000_000, 8, 4
BITS = 16384
#: Groups with more sets to pair than this are dealt anew by the shingles they share.
MANY = 32 * BLOCK
#: Hashes by which groups of more than a block are known in a broadcast table: so many rows at most.
HEAVY = 1 << 16


def spare(n, percent: int = PERCENT):
    """The most shingles of a set of n that a partner can lack."""
    return n - -(-n * percent // 100)


def shingle_sets(texts: list[bytes], k: int):
    """For each text its sorted distinct shingle hashes."""
    for lo, hi in chunks(texts):
        hashes, first, _, _ = hashing.words(texts[lo:hi], lower=True)
        for a, b in itertools.pairwise(first):
            yield np.unique(hashing.shingles(hashes[a:b], k))


def digest(tokens: np.ndarray) -> int:
    """A set's node id; the empty set has none."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), 20) - (1 << 63)


def _least_type(top: int) -> int:
    return 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes: of all sets, or of those that have any if that is shorter, so that a cell never outgrows its keys."""
    size, width = _least_type(counts.max(initial=0)), _least_type(len(counts))
    some = np.flatnonzero(counts)
    if len(some) * (size + width) < len(counts) * size:
        return bytes([size, width]) + some.astype(f"<u{width}").tobytes() + counts[some].astype(f"<u{size}").tobytes()
    return bytes([size, 0]) + counts.astype(f"<u{size}").tobytes()


def counted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(set, count) from packed_counts."""
    size, width = raw[0], raw[1]
    if not width:
        counts = np.frombuffer(raw, f"<u{size}", offset=2).astype(np.int64)
        return np.arange(len(counts)), counts
    n = (len(raw) - 2) // (size + width)
    return np.frombuffer(raw, f"<u{width}", n, 2).astype(np.int64), np.frombuffer(raw, f"<u{size}", n, 2 + n * width).astype(np.int64)


# ---- occurrence count -------------------------------------------------------------------------------------


def _heads_and_keys(k: int, buckets: int, mode: str):
    """mode 'head': a row for each document. mode 'keys': rows of packed hashes for each block and bucket."""

    def run(batches):
        turn = 0
        for batch in batches:
            texts = text_bytes(batch.column(1))
            if mode == "head":
                found = [(digest(s) if len(s) else None, len(s)) for s in shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "h", "node", "n_shingles"])
                continue
            for lo, hi in chunks(texts, BLOCK_BYTES):
                yield from packed(texts[lo:hi], (TaskContext.get().partitionId() << 32) + turn)
                turn += 1

    def packed(texts, tag):
        sets = list(shingle_sets(texts, k))
        sizes = np.array([len(s) for s in sets], np.int64)
        nodes = [digest(s) if len(s) else None for s in sets]
        # one copy of each set is enough for the count
        seen: dict[int, int] = {}
        keep = [i for i, x in enumerate(nodes) if x is not None and seen.setdefault(x, i) == i]
        if not keep:
            return
        who = np.repeat(np.arange(len(keep), dtype=np.uint32), sizes[keep])
        flat = np.concatenate([sets[i] for i in keep])
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        same = flat[1:] == flat[:-1]
        many = np.zeros(len(flat), bool)
        many[1:] |= same
        many[:-1] |= same
        first = np.ones(len(flat), bool)
        first[1:] = ~same
        who[many] = np.uint32(0xFFFFFFFF)  # in two sets of the block already: nobody's single
        flat, who = flat[first], who[first]
        # by bucket, then set: a cell holds its keys and how many of them each set has, last those of no single set
        order = np.argsort(np.minimum(who, len(keep)), kind="stable")
        flat, who = flat[order], np.minimum(who[order], len(keep)).astype(np.int64)
        bucket = ((flat & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        flat, who, bucket = flat[order], who[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        names = np.array([nodes[i] for i in keep], np.int64)
        rows = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        low = (flat >> np.uint64(32)).astype(np.uint32)
        cells = [(low[a:b].tobytes(), packed_counts(np.bincount(who[a:b], minlength=len(keep) + 1))) for a, b in ((cuts[r], cuts[r + 1]) for r in rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([tag] * len(rows), pa.int64()), pa.array([len(keep)] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())],
            names=["block", "width", "bucket", "keys", "who"],
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([tag], pa.int64()), pa.array([len(keep)], pa.int32()), pa.array([-1], pa.int32()), pa.array([names.tobytes()], pa.binary()), pa.array([sizes[keep].tobytes()], pa.binary())],
            names=["block", "width", "bucket", "keys", "who"],
        )

    return run


def _singles(table: pa.Table) -> pa.Table:
    """Of one bucket: how many shingles each block's sets have that no other set has."""
    blocks, widths = table["block"].to_pylist(), table["width"].to_pylist()
    if table["bucket"][0].as_py() < 0:
        return pa.table({"block": table["block"], "width": table["width"], "names": table["keys"], "counts": table["who"]})
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    who = [np.repeat(*counted(x)) for x in table["who"].to_pylist()]
    flat = np.concatenate(keys)
    ordered = np.sort(flat)
    same = ordered[1:] == ordered[:-1]
    lone = np.ones(len(flat), bool)
    lone[1:] &= ~same
    lone[:-1] &= ~same
    lone = lone[np.searchsorted(ordered, flat)]
    out, at = [], 0
    for k, w, n in zip(keys, who, widths, strict=True):
        mine = w[lone[at : at + len(k)]]
        at += len(k)
        out.append(packed_counts(np.bincount(mine, minlength=n + 1)[:n]))
    return pa.table({"block": pa.array(blocks, pa.int64()), "width": pa.array(widths, pa.int32()), "names": pa.nulls(len(out), pa.binary()), "counts": pa.array(out, pa.binary())})


def _candidates(percent: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(table["width"][0].as_py(), np.int64)
        for name, counts in zip(table["names"].to_pylist(), table["counts"].to_pylist(), strict=True):
            if name is not None:
                names, sizes = np.frombuffer(name, np.int64), np.frombuffer(counts, np.int64)
            else:
                who, n = counted(counts)
                total[who] += n
        keep = total <= spare(sizes, percent)
        return pa.table({"node": pa.array(names[keep], pa.int64())})

    return run


# ---- trees --------------------------------------------------------------------------------------------------


class Node:
    __slots__ = ("bits", "kids", "least", "most", "rows", "slack")

    def __init__(self, rows, kids, bits, least, most, slack):
        self.rows, self.kids, self.bits, self.least, self.most, self.slack = rows, kids, bits, least, most, slack


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def build(sets: list[np.ndarray]) -> Node:
    """A signature tree: leaves of LEAF sets in order of size, then of smallest shingle."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
    level = []
    for lo in range(0, len(order), LEAF):
        rows = order[lo : lo + LEAF]
        maps = [bitmap(sets[i]) for i in rows]
        level.append(Node(rows, None, np.bitwise_or.reduce(maps), len(sets[rows[0]]), len(sets[rows[-1]]), max(len(sets[i]) - int(np.bitwise_count(m).sum()) for i, m in zip(rows, maps, strict=True))))
    while len(level) > 1:
        level = [join_nodes(level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def join_nodes(kids: list[Node]) -> Node:
    return Node([r for k in kids for r in k.rows], kids, np.bitwise_or.reduce([k.bits for k in kids]), min(k.least for k in kids), max(k.most for k in kids), max(k.slack for k in kids))


def can_meet(least_a, most_a, slack_a, bits_a, least_b, most_b, slack_b, bits_b, percent: int) -> bool:
    """False only if no set below one node can be similar enough to one below the other.

    Shared shingles lie in shared bits; a set has at most slack more shingles than bits. Similar sets share at
    least percent / (100 + percent) of the sum of their sizes, and percent / 100 of the larger.
    """
    if 100 * most_a < percent * least_b or 100 * most_b < percent * least_a:
        return False
    most = min(most_a, most_b, int(np.bitwise_count(bits_a & bits_b).sum()) + min(slack_a, slack_b))
    return (100 + percent) * most >= percent * (least_a + least_b) and 100 * most >= percent * max(least_a, least_b)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, int]:
    if 100 * len(a) < percent * len(b) or 100 * len(b) < percent * len(a):
        return False, -1
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both), both


class Forest:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def dual(a: Node, b: Node, sets: list[np.ndarray], forest: Forest, percent: int):
    """Links between sets below a and below b, only such as connect what is not connected yet."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not can_meet(a.least, a.most, a.slack, a.bits, b.least, b.most, b.slack, b.bits, percent):
            continue
        root = forest.find(a.rows[0])
        if all(forest.find(i) == root for i in a.rows) and all(forest.find(i) == root for i in b.rows):
            continue
        if a.kids is None and b.kids is None:
            for i, j in itertools.combinations(a.rows, 2) if a is b else itertools.product(a.rows, b.rows):
                if forest.find(i) != forest.find(j) and similar(sets[i], sets[j], percent)[0]:
                    forest.join(i, j)
                    yield i, j
        elif a is b:
            stack += [(a.kids[i], a.kids[j]) for i in range(len(a.kids)) for j in range(i, len(a.kids))][::-1]
        elif b.kids is None or (a.kids is not None and len(a.rows) >= len(b.rows)):
            stack += [(x, b) for x in a.kids]
        else:
            stack += [(a, x) for x in b.kids]


def _tokens(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _whole_links(percent: int):
    """Links of groups of at most a block, whose rows (comp, node, tokens) come one group after the other: one tree each, met with itself."""

    def links(nodes: list[int], tokens: list[bytes]):
        sets = _tokens(tokens)
        tree = build(sets)
        return [(nodes[i], nodes[j]) for i, j in dual(tree, tree, sets, Forest(len(sets)), percent)]

    def run(batches):
        at, nodes, tokens = None, [], []
        for batch in batches:
            found = []
            for comp, node, raw in zip(*(batch.column(c).to_pylist() for c in ("comp", "node", "tokens")), strict=True):
                if comp != at:
                    found += links(nodes, tokens) if len(nodes) > 1 else []
                    at, nodes, tokens = comp, [], []
                nodes.append(node)
                tokens.append(raw)
            yield _link_batch(found)
        yield _link_batch(links(nodes, tokens) if len(nodes) > 1 else [])

    return run


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _roots(table: pa.Table) -> pa.Table:
    """The root node of one block's tree."""
    sets = _tokens(table["tokens"].to_pylist())
    root = build(sets)
    made = {"least": pa.array([root.least], pa.int64()), "most": pa.array([root.most], pa.int64()), "slack": pa.array([root.slack], pa.int64()), "bits": pa.array([root.bits.tobytes()], pa.binary())}
    return pa.table({c: table[c][:1] for c in ("comp", "blk", "joined", "cls")} | made)


def _pair_links(percent: int):
    """Dual traversal of the trees of two blocks (or of one with itself)."""

    def run(table: pa.Table) -> pa.Table:
        nodes, sides, joined = (table[c].to_pylist() for c in ("node", "side", "joined"))
        sets = _tokens(table["tokens"].to_pylist())
        left, right = ([i for i, s in enumerate(sides) if s == k] for k in (0, 1))
        forest = Forest(len(sets))
        anchor = next((i for i, x in enumerate(joined) if x), None)
        for i, x in enumerate(joined):
            if x:
                forest.join(i, anchor)
        trees = [relabel(build([sets[i] for i in side]), side) for side in (left, right) if side]
        found = list(dual(trees[0], trees[-1], sets, forest, percent))
        return pa.Table.from_batches([_link_batch([(nodes[i], nodes[j]) for i, j in found])])

    return run


def relabel(node: Node, names: list[int]) -> Node:
    node.rows = [names[i] for i in node.rows]
    for k in node.kids or ():
        relabel(k, names)
    return node


# ---- the join -----------------------------------------------------------------------------------------------


def jaccard_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, node, n_shingles, component_id, root) for every row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; the set holds the distinct k-word
    shingles, or the whole sequence if it is shorter. Two documents link when
    100 * intersection >= percent * union. component_id is the smallest id reachable by links, root is a node
    that all of a component share, h the xxhash64 of the text. No text or no words: the empty set, node and root
    null, linked with nothing, component_id its own id. A null id is linked like others, and is larger than all
    ids: component_id is null only if none of the component has an id. Repeated rows and repeated ids: each row
    has its own set and gets a row. Shingles and sets are known by 64-bit hashes.
    """
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    heads = stage(docs.mapInArrow(lean(_heads_and_keys(k, 1, "head")), "doc_id long, h long, node long, n_shingles long"), "jaccard-heads")
    links = similar_nodes(docs, heads, k, percent)
    roots = components(links, "jaccard-components")
    nodes = heads.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    nodes = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low")
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(lows, "root").select("node", "component_id", "root")
    filled = heads.where("node is not null").join(named, "node", "left").select("doc_id", "h", "node", "n_shingles", "component_id", "root")
    lone = heads.where("node is null").select("doc_id", "h", "node", "n_shingles", F.col("doc_id").alias("component_id"), F.col("node").alias("root"))
    return filled.union(lone)


def _exploded(batches):
    """A row (node, n, t) for each shingle of the sets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            flat = _tokens(part.column("tokens").to_pylist())
            if flat:
                size = [len(x) for x in flat]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), size)), pa.array(np.repeat(part.column("n").to_numpy(), size)), pa.array(np.concatenate(flat).view(np.int64))], names=["node", "n", "t"])


def _token_rows(k: int):
    """(node, n, tokens) of texts whose set is the wanted one."""

    def run(batches):
        for batch in batches:
            texts, nodes = text_bytes(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, BLOCK_BYTES):
                sets = [(n, s) for n, s in zip(nodes[lo:hi], shingle_sets(texts[lo:hi], k), strict=True) if len(s) and digest(s) == n]
                columns = [pa.array([n for n, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "tokens"])

    return run


def similar_nodes(docs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): similar pairs of nodes that connect every group of similar nodes."""
    total = heads.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET))
    packed = docs.select("doc_id", "text").mapInArrow(lean(_heads_and_keys(k, buckets, "keys")), "block long, width int, bucket int, keys binary, who binary")
    # a block's header rows are spread by block, its keys by bucket
    packed = packed.withColumn("part", F.when(F.col("bucket") < 0, F.pmod("block", F.lit(buckets)).cast("int")).otherwise(F.col("bucket")))
    counts = packed.groupBy("part", F.col("bucket") < 0).applyInArrow(lambda t: _singles(t), "block long, width int, names binary, counts binary")
    nodes = counts.groupBy("block").applyInArrow(_candidates(percent), "node long").distinct()
    # one text stands for each candidate set
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r")
    chosen = heads.where("node is not null").groupBy("node").agg(least).join(nodes, "node").select("node", "r.doc_id", "r.h")
    chosen = stage(chosen, "jaccard-chosen")
    same = docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (docs["h"] == chosen["h"])
    # the chosen texts grow with the input: a shuffled join that can spill at every size
    sets = docs.join(chosen.hint("merge"), same).select("text", "node").mapInArrow(lean(_token_rows(k)), "node long, n long, tokens binary").dropDuplicates(["node"])
    sets = stage(sets, "jaccard-sets")

    occur = sets.mapInArrow(lean(_exploded), "node long, n long, t long")
    shared = occur.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    known = occur.join(shared, "t")
    # the rarest spare + 1 shingles of a set are its prefix; those that occur once lead it and meet nobody
    per = known.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    room = F.expr(f"cast(n - ceil(n * {percent}D / 100D) + 1 - (n - size(ts)) as int)")
    prefix = per.withColumn("room", room).where("room > 0").select("node", "n", F.explode(F.slice("ts", F.lit(1), F.least("room", F.size("ts")))["t"]).alias("t"))
    prefix = stage(prefix, "jaccard-prefix")
    first = prefix.groupBy("t").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("t", "a")
    members = components(prefix.join(first, "t").select("a", F.col("node").alias("b")), "jaccard-groups")
    links = stage(group_links(sets, members.select("node", F.col("root").alias("comp")), prefix, percent), "jaccard-links")
    remove(chosen, sets, prefix)
    return links


def _hashed(comp) -> Column:
    return F.pmod(F.xxhash64(comp), F.lit(HEAVY))


def parted(members: DataFrame) -> DataFrame:
    """members (comp, node, n) with parts: null for groups of at most a block, else how many blocks they have at least.

    Large groups are known by a hash below HEAVY, so the broadcast table has HEAVY rows at most, however many they
    are; a small group with the hash of a large one is treated as large too.
    """
    crowd = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    heavy = crowd.where("parts > 1").groupBy(_hashed("comp").alias("hb")).agg(F.max("parts").alias("parts"))
    return members.withColumn("hb", _hashed("comp")).join(F.broadcast(heavy), "hb", "left").drop("hb")


def group_links(sets: DataFrame, members: DataFrame, prefix: DataFrame | None, percent: int) -> DataFrame:
    """Links within groups of candidates (node, comp); prefix (node, n, t) allows large groups to be dealt anew."""
    members = stage(parted(sets.select("node", "n").join(members, "node")), "jaccard-members")
    whole = members.where("parts is null").join(sets.select("node", "tokens"), "node").select("comp", "node", "tokens")
    links = whole.repartition("comp").sortWithinPartitions("comp", "node").mapInArrow(lean(_whole_links(percent)), "a long, b long")
    large = members.where("parts is not null")
    if large.isEmpty():
        return links
    return links.union(crowd_links(sets, large, prefix, percent))


def crowd_links(sets: DataFrame, large: DataFrame, prefix: DataFrame | None, percent: int) -> DataFrame:
    """Links within groups of more than a block (comp, node, n, parts): pivots first, then pruned pairs of blocks.

    Joins by group go by (comp, salt), a salt for each of a group's parts, so that no task gets a whole group.
    """
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")
    pivots = large.groupBy("comp").agg(F.max_by("node", F.struct("n", "node")).alias("node"), F.max("parts").alias("parts"))
    pivots = pivots.join(sets.select("node", F.col("tokens").alias("pivot_tokens")), "node").select("comp", F.col("node").alias("pivot"), "pivot_tokens", salts)

    def distances(batches):
        for batch in batches:
            a, b = (_tokens(batch.column(c).to_pylist()) for c in ("tokens", "pivot_tokens"))
            far, ok = [], []
            for x, y in zip(a, b, strict=True):
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                union = len(x) + len(y) - both
                far.append(1 - both / union)
                ok.append(100 * both >= percent * union)
            least = pa.array([int(x[0]) - (1 << 63) for x in a], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("comp", "node", "n", "parts", "salt", "pivot")), least, pa.array(far, pa.float64()), pa.array(ok, pa.bool_())], names=["comp", "node", "n", "parts", "salt", "pivot", "least", "far", "joined"])

    met = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts"))).join(sets.select("node", "tokens"), "node").join(pivots, ["comp", "salt"])
    met = met.select("comp", "node", "n", "parts", "salt", "tokens", "pivot", "pivot_tokens").mapInArrow(lean(distances), "comp long, node long, n long, parts long, salt long, pivot long, least long, far double, joined boolean")
    met = stage(met, "jaccard-pivots")
    star = met.where("joined and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    # one minus Jaccard is a metric: a member joined to the pivot can only meet a stranger this near to the pivot
    reach = 1 - percent / 100 + 1e-9
    nearest = met.where("not joined").groupBy("comp").agg(F.min("far").alias("nearest"), F.max("parts").alias("parts")).select("comp", "nearest", salts)
    todo = met.join(nearest, ["comp", "salt"]).where(f"not joined or far + {reach} >= nearest")
    todo = stage(todo.select("comp", "node", "n", "parts", "least", "joined"), "jaccard-todo")
    if todo.isEmpty():
        return star
    if prefix is not None:
        many = todo.groupBy("comp").agg(F.count("*").alias("m")).where(f"m > {MANY}").groupBy(_hashed("comp").alias("hb")).agg(F.lit(True).alias("many"))
        todo = todo.withColumn("hb", _hashed("comp")).join(F.broadcast(many), "hb", "left").drop("hb")
        anew = shared_groups(todo.where("many"), prefix)
        todo = todo.where("many is null")
        if not anew.isEmpty():
            star = star.union(group_links(sets, anew, None, percent))
    return star.union(block_links(sets, todo, percent))


def shared_groups(todo: DataFrame, prefix: DataFrame) -> DataFrame:
    """(node, comp): members of large groups dealt by the prefix shingles that two or more share, strangers to the pivot among them.

    Any link lies within one of these groups. Shingles shared by the very same members make one group.
    """
    at = prefix.join(todo.select("node", "joined"), "node").select("t", "node", "joined")
    who = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (0, 1)]
    per = at.groupBy("t").agg(F.count("*").alias("m"), F.count_if(~F.col("joined")).alias("strangers"), *who).where("m > 1 and strangers > 0")
    kept = per.groupBy("m", "x0", "x1").agg(F.min("t").alias("t")).select("t")
    return stage(at.join(kept, "t").select("node", F.col("t").alias("comp")), "jaccard-anew")


def block_links(sets: DataFrame, todo: DataFrame, percent: int) -> DataFrame:
    """Links within groups, todo (comp, node, n, parts, least, joined): blocks of like sets, whose roots are paired before any is opened."""
    todo = todo.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent + 1e-9)).cast("int")).withColumn("heap", F.pmod(F.xxhash64("least"), F.col("parts")))
    key = ["comp", "joined", "cls", "heap"]
    crowd = todo.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("slots"))
    todo = todo.join(crowd, key).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")))
    todo = todo.select("comp", "node", "joined", "cls", F.xxhash64(*key, "slot").alias("blk"))
    blocks = stage(todo.join(sets.select("node", "tokens"), "node").select("comp", "blk", "joined", "cls", "node", "tokens"), "jaccard-blocks")
    roots = blocks.groupBy("comp", "blk").applyInArrow(_roots, "comp long, blk long, joined boolean, cls int, least long, most long, slack long, bits binary")
    roots = stage(roots, "jaccard-roots")
    other = roots.select("comp", *(F.col(c).alias(f"{c}_b") for c in roots.columns if c != "comp"))
    other = other.withColumn("cls", F.explode(F.array(F.col("cls_b") - 1, F.col("cls_b"), F.col("cls_b") + 1)))
    pairs = roots.join(other, ["comp", "cls"]).where("not (joined and joined_b)").where("blk = blk_b or joined <> joined_b and joined or joined = joined_b and blk < blk_b")

    @F.pandas_udf("boolean")
    def open_(least: pd.Series, most: pd.Series, slack: pd.Series, bits: pd.Series, least_b: pd.Series, most_b: pd.Series, slack_b: pd.Series, bits_b: pd.Series) -> pd.Series:
        view = lambda x: np.frombuffer(x, np.uint64)
        return pd.Series([can_meet(a, b, c, view(d), e, f, g, view(h), percent) for a, b, c, d, e, f, g, h in zip(least, most, slack, bits, least_b, most_b, slack_b, bits_b, strict=True)], dtype=bool)

    sides = ("least", "most", "slack", "bits")
    pairs = pairs.where(open_(*(F.col(c) for c in sides), *(F.col(f"{c}_b") for c in sides))).select("comp", F.col("blk").alias("i"), F.col("blk_b").alias("j"))
    left = pairs.select("comp", "i", "j", F.lit(0).alias("side"), F.col("i").alias("blk"))
    right = pairs.where("i <> j").select("comp", "i", "j", F.lit(1).alias("side"), F.col("j").alias("blk"))
    opened = left.union(right).join(blocks, ["comp", "blk"]).select("comp", "i", "j", "side", "joined", "node", "tokens")
    return opened.groupBy("comp", "i", "j").applyInArrow(_pair_links(percent), "a long, b long")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Groups of near-copies over all documents: doc_id, n_shingles, component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-copies stays: that of the smallest id, then of the smallest hash of its text; null ids are largest.

    Of rows that repeat both id and text one stays, the first by its other columns' JSON. A row whose text is in no
    group stays whatever its id repeats. Texts without words are in no group and all kept.
    """
    groups = jaccard_groups(docs, k, percent).where("root is not null")
    per = stage(groups.groupBy("root", "doc_id", "h").agg(F.count("*").alias("m")), "jaccard-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    keeper = per.groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("texts"), F.sum("m").alias("m"))
    # rows of groups of one are left alone
    same = per["doc_id"].eqNullSafe(F.col("best.doc_id")) & (per["h"] == F.col("best.h"))
    crowded = keeper.where("m > 1").select("root", "best", F.lit(True).alias("crowded"))
    marked = per.join(crowded, "root").select("doc_id", "h", F.when(same, per["m"]).otherwise(0).alias("stays"))
    gone = marked.where("stays <> 1").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), "stays")
    gone = stage(gone, "jaccard-gone")
    hit = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("gone_h"))
    kept = docs.join(gone, hit, "left_anti")
    rest = gone.where("stays > 1")
    if rest.isEmpty():
        return kept
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.join(rest, hit, "left_semi").select(F.col("doc_id").alias("a"), F.xxhash64("text").alias("b"), whole.alias("row"), F.to_json(whole).alias("order"))
    once = repeated.groupBy("a", "b").agg(F.min_by("row", "order").alias("row"))
    return kept.unionByName(once.select("row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(ws) - 4, 1)), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) AS shingle FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(low) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""
