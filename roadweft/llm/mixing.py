"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Words stand for tokens. Each source's documents are laid end to end in a shuffled order, as a stream that is
read at most twice, and the stream is cut into blocks of equal size. The targets, in blocks, are laid end to end as
well: a line of as many places as there are blocks to take. Slot n of the schedule is the van der Corput point of n,
its bits in reverse; the source whose part of the line holds the point gets the slot, and points beyond the line
are passed over. A slot's rank among those of its source says which block it takes; a source's last slot takes what
is left of its target. So slots alone decide what a source gives, and every stretch of the schedule holds the
sources in nearly the target shares.

A rank is counted from the bits of slot and place, and positions in a stream are prefix sums in two levels (hash
buckets), so a source with a third of all rows is not gathered in a task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.llm.common import partitions, range_bounds, range_of, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words of all targets for each word of the input; passes over a source at most; words of a block.
SHARE, PASSES, BLOCK = 1.5, 2, 512
#: Bits of the hash that orders a source's documents that lie below its bucket, and bins in which points meet sources.
BELOW, BINS = 22, 4096
#: Sources whose targets are broadcast: a short name and five numbers each.
MOST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, weight, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh weights, repeating. A target stops at passes times its
    source's size; what is over is shared by weight among the others until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    # in order of size to weight, the first source whose even share fits sets the level for the rest
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("room", F.lit(share) * F.sum("source_size").over(everything) - passes * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    per = per.withColumn("level", F.col("room") / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    fits = F.col("level") * F.col("weight") <= passes * F.col("source_size")
    per = per.withColumn("place", F.row_number().over(order)).withColumn("first", F.min(F.struct(F.when(fits, F.col("place")).otherwise(F.lit(1 << 30)).alias("p"), "level")).over(everything))
    target = F.when(F.col("place") < F.col("first.p"), (passes * F.col("source_size")).cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return per.select("source", "weight", "source_size", target.alias("target"), "rank")


def streams(rows: DataFrame) -> DataFrame:
    """rows (file, row, doc_id, source, size, mark) with pos, the words of its source before it in the shuffled order."""
    key = F.coalesce(F.pmod("doc_id", F.lit(1 << 31)), F.lit(0)) * F.lit(2654435761)
    # rows without an id would all have one hash: they are spread by what they hold
    key = F.when(F.col("doc_id").isNull(), F.col("mark")).otherwise(key)
    rows = rows.withColumn("h", F.pmod(key, F.lit(1 << 32))).withColumn("bucket", F.shiftright("h", BELOW))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "mark", "file", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    same = rows["source"].eqNullSafe(base["source"]) & (rows["bucket"] == base["bucket"])
    kept = (rows[c] for c in ("file", "row", "doc_id", "source", "size"))
    return rows.join(base, same).select(*kept, (F.col("base") + F.col("inside")).alias("pos"))


def reversed_bits(n: Column, bits: int) -> Column:
    """The whole number below 2 ** bits whose bits are those of n in reverse: 2 ** bits times the van der Corput point of n."""
    if not bits:
        return F.lit(0).cast("long")
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long")


def slot_rank(slot: Column, lo: Column, hi: Column, bits: int) -> Column:
    """How many slots before this one have points from lo to hi - 1.

    The slots before it are runs of 2 ** k slots, one for each bit k that it has. The points of such a run are the
    reverse of the bits above k, and from there every 2 ** (bits - k)-th.
    """

    def below(edge: Column, start: Column, step: int, count: int) -> Column:
        found = F.floor((edge - start + (step - 1)) / F.lit(step)) if step == 1 else F.shiftright(edge - start + (step - 1), step.bit_length() - 1)
        return F.least(F.greatest(found, F.lit(0)), F.lit(count))

    total, start = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in reversed(range(bits)):
        has = F.shiftright(slot, k).bitwiseAND(F.lit(1))
        step, count = 1 << (bits - k), 1 << k
        total = total + has * (below(hi, start, step, count) - below(lo, start, step, count))
        start = start + has * F.lit(1 << (bits - 1 - k))
    return total


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, block_no, words): the block of its source that each slot takes, and how many of its words.

    A source has as many slots as its target has blocks, the last of which takes what is left of the target's whole
    part. Sources without words have none. Slots are numbered with gaps where points lie beyond the line.
    """
    spark = goals.sparkSession
    parts = goals.select("rank", F.floor("target").alias("upto")).where("upto > 0").withColumn("blocks", F.ceil(F.col("upto") / block))
    parts = parts.withColumn("hi", F.sum("blocks").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("blocks"))
    places = goals.agg(F.sum(F.ceil(F.floor("target") / block))).first()[0] or 0
    bits = max(places - 1, 0).bit_length()
    bin_size = max(1, -(-places // BINS))
    # at most BINS rows and one more for each source: small beside the slots
    binned = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor((F.col("hi") - 1) / bin_size))))
    points = spark.range(1 << bits if places else 0).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point")).where(F.col("point") < places)
    hit = points.withColumn("bin", F.floor(F.col("point") / bin_size)).join(binned, "bin").where("point >= lo and point < hi")
    ranked = hit.withColumn("block_no", slot_rank(F.col("slot"), F.col("lo"), F.col("hi"), bits))
    return ranked.select("slot", "rank", "block_no", F.least(F.lit(block), F.col("upto") - F.col("block_no") * block).alias("words"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix of rows (file, row, doc_id, source, size, mark), file and row together distinct, and the targets.

    First result: (file, row, slot, pass, first, words): the words first .. first + words of a document that a slot
    takes. Documents without words are never taken. Null sources are a source; rows that repeat an id, and those
    without one, are documents of their own. Equal ids and sizes go by mark, so where rows lie changes nothing.
    """
    goals = stage(targets(rows, weights, share, passes), "mix-targets")
    laid = streams(rows).where("size > 0")
    laid = laid.join(F.broadcast(goals) if goals.count() < MOST_SOURCES else goals, laid["source"].eqNullSafe(goals["source"])).select("file", "row", "rank", "size", "pos", "source_size")
    laid = laid.withColumn("pass", F.explode(F.array(*map(F.lit, range(passes))))).withColumn("at", F.col("pos") + F.col("pass") * F.col("source_size"))
    laid = laid.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    met = laid.join(schedule(goals, block), ["rank", "block_no"])
    start = F.col("block_no") * block
    met = met.withColumn("lo", F.greatest("at", start)).withColumn("hi", F.least(F.col("at") + F.col("size"), start + F.col("words"))).where("hi > lo")
    return met.select("file", "row", "slot", "pass", (F.col("lo") - F.col("at")).alias("first"), (F.col("hi") - F.col("lo")).alias("words")), goals


def located(docs: DataFrame) -> DataFrame:
    """docs with their columns as c0, c1, ... and where each row lies: file (a hash of its path) and row in the file.

    The same for every scan of the same files. What is no table of files is written as one first.
    """
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    where = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("the name is taken")
        return docs.select(*names, *where)
    except AnalysisException:
        return stage(docs.select(*names), "mix-docs").select("*", *where)


def mark(placed: DataFrame) -> Column:
    """A hash of all columns of documents as located() gives them, the same wherever a row lies."""
    fields = [f for f in placed.schema.fields if f.name not in ("file", "row")]
    unhashed = [any(kind in f.dataType.simpleString() for kind in ("map<", "variant")) for f in fields]
    values = [F.to_json(F.struct(f.name)) if u else F.col(f.name) for f, u in zip(fields, unhashed, strict=True)]
    return F.xxhash64(*(x for v in values for x in (v, v.isNull())))


def numbered(placed: DataFrame, columns: list[str]) -> DataFrame:
    """(file, row, doc_id, source, size, mark) of documents as located() gives them; columns are their own names."""
    own = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    size = F.coalesce(F.regexp_count(own["text"], F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return stage(placed.select("file", "row", own["doc_id"].cast("long").alias("doc_id"), own["source"].cast("string").alias("source"), size.alias("size"), mark(placed).alias("mark")), "mix-rows")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken, first_slot (null: not taken), slots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = numbered(located(docs), docs.columns)
    pieces, goals = mix(rows)
    taken = pieces.groupBy("file", "row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("slots"))
    goals = goals.select(F.col("source").alias("goal_source"), "source_size", "target")
    out = rows.join(taken, ["file", "row"], "left").join(F.broadcast(goals) if goals.count() < MOST_SOURCES else goals, F.col("source").eqNullSafe(F.col("goal_source")))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), "first_slot", F.coalesce("slots", zero).alias("slots"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of docs, in the order of the schedule: a row for each pass over a document, its text the words taken.

    A pass comes where the first slot that takes of it is, in a slot by a hash of the row: reruns agree on tables in other files, too. A text that a pass takes whole stays as it is; else its
    words are joined by a space. n_chars follows the text. Documents without words go, as no slot takes them.
    """
    placed = located(docs)
    pieces, _ = mix(numbered(placed, docs.columns))
    spans = pieces.groupBy("file", "row", "pass").agg(F.min("first").alias("first"), F.sum("words").alias("words"), F.min("slot").alias("slot"))
    spans = stage(spans, "mix-spans")
    bounds = range_bounds(spans, F.col("slot"), partitions(docs.sparkSession))
    per = spans.groupBy("file", "row").agg(F.collect_list(F.struct("pass", "first", "words", "slot")).alias("spans"))
    out = placed.withColumn("mark", mark(placed)).join(per, ["file", "row"]).withColumn("s", F.explode("spans")).drop("spans")
    out = out.repartitionById(len(bounds) + 1, range_of(F.col("s.slot"), bounds)).sortWithinPartitions("s.slot", "mark", "s.pass", "s.first", "s.words")
    own = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    words = F.filter(F.split(own["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, (F.col("s.first") + 1).cast("int"), F.col("s.words").cast("int")), " ")
    out = out.withColumn("new", F.when(F.col("s.words") == F.regexp_count(own["text"], F.lit(WORD)), own["text"]).otherwise(cut))
    changed = {"text": F.col("new")}
    if "n_chars" in own:
        changed["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, x).alias(c) for c, x in own.items()))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, row_number() OVER v AS place, sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_weight,
  1.5e0 * (SELECT sum(size)::BIGINT FROM d) - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room
  FROM w WINDOW v AS (ORDER BY source_size::DOUBLE / weight, rank)),
l AS (SELECT *, room / left_weight AS level FROM o),
f AS (SELECT place, level FROM l WHERE level * weight <= 2 * source_size ORDER BY place LIMIT 1),
g AS (SELECT l.source, l.source_size, CASE WHEN l.place < f.place THEN (2 * l.source_size)::DOUBLE ELSE f.level * l.weight END AS target FROM l, f),
p AS (SELECT d.*, row_number() OVER () AS row, coalesce(sum(size) OVER (PARTITION BY source ORDER BY (((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648) * 2654435761) % 4294967296, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d),
q AS (SELECT source, source_size, target, floor(target)::BIGINT AS upto, ceil(floor(target) / 512)::BIGINT AS blocks, sum(ceil(floor(target) / 512)) OVER (ORDER BY source NULLS LAST)::BIGINT AS hi FROM g),
n AS (SELECT sum(blocks)::BIGINT AS places, ceil(log2(sum(blocks)))::BIGINT AS bits FROM q),
v AS (SELECT i AS slot, list_sum(list_transform(range(bits), lambda k: ((i >> k) & 1) << (bits - 1 - k)))::BIGINT AS point FROM n, range(1 << 20) r(i) WHERE i < (1 << bits)),
t AS (SELECT slot, source, upto, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block_no FROM v JOIN q ON point >= hi - blocks AND point < hi),
b AS (SELECT slot, source, 512 * block_no AS lo, least(512 * block_no + 512, upto) AS hi FROM t),
a AS (SELECT p.*, pos + y * source_size AS place FROM p JOIN g USING (source), range(2) r(y) WHERE p.source IS NOT NULL UNION ALL SELECT p.*, pos + y * source_size AS place FROM p JOIN g ON p.source IS NULL AND g.source IS NULL, range(2) r(y)),
m AS (SELECT a.row, sum(least(place + size, hi) - greatest(place, lo))::BIGINT AS taken, min(slot) AS first_slot, count(DISTINCT slot) AS slots
  FROM a JOIN b ON a.source IS NOT DISTINCT FROM b.source AND lo < place + size AND place < hi WHERE size > 0 GROUP BY a.row)
SELECT p.doc_id, p.size, g.source_size, g.target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(slots, 0) AS slots
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN m ON m.row = p.row
"""
