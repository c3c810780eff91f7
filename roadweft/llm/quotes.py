"""Chat formatting by quotation linking; DataFrame functions only.

A line that begins with '>' marks is quoted, as deep as it has marks. Runs of lines of one depth are passages;
a passage is normalised (lower case, white space runs to a space) and hashed, with 128 bits, so equal hashes are equal texts. Messages are indexed by the hash
of every unquoted passage, paragraph and line. A passage is linked to the last earlier message of its
conversation that has its hash, else to the first message of all that has it. A passage of several lines that none has
is looked up by its pieces in the same way: its run of lines without the blank ones, its paragraphs, and stretches of
its lines; the piece of most lines that is found gives the link, a single line only within the conversation.
The reply's parent is the message that its shallowest linked passage quotes. Conversations come back in reply order,
each message without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.llm.common import stage

#: Lines without text part paragraphs.
SPACE = r"[ \t\n\x0B\f\r]"
PARAGRAPH = rf"\n{SPACE}*\n"
MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: Turns of a conversation that are looked through in one go.
STRETCH = 4096


def normal(text):
    return F.trim(F.regexp_replace(F.lower(text), SPACE + "+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """A row for each line of messages (m, conv_id, turn, text): line number, depth and body."""
    out = messages.select("m", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("line", "raw"))
    marks = F.regexp_extract("raw", MARKS, 1)
    depth = F.length(F.regexp_replace(marks, "[^>]", ""))
    return out.select("m", "conv_id", "turn", "line", depth.alias("depth"), F.regexp_replace("raw", MARKS, "").alias("body"))


def passages(parsed: DataFrame) -> DataFrame:
    """Runs of lines of one depth: m, conv_id, turn, first line, depth, body."""
    order = W.partitionBy("m").orderBy("line")
    step = F.when(F.col("depth") != F.coalesce(F.lag("depth").over(order), F.lit(-1)), 1).otherwise(0)
    runs = parsed.withColumn("step", step).withColumn("run", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)))
    grouped = runs.groupBy("m", "conv_id", "turn", "run", "depth").agg(F.sort_array(F.collect_list(F.struct("line", "body"))).alias("ls"))
    return grouped.select("m", "conv_id", "turn", "depth", F.col("ls")[0]["line"].alias("line"), F.array_join(F.col("ls.body"), "\n").alias("body"))


def line_hashes(body: Column) -> Column:
    """Hashes of the lines of a text that are not blank."""
    return F.transform(F.filter(F.transform(F.split(body, "\n"), normal), lambda x: x != ""), lambda x: F.md5(x))


def window_hash(hashes: Column, start: Column, k: Column) -> Column:
    """Hash of k lines from start, counted from 0."""
    return F.md5(F.concat_ws(" ", k.cast("string"), F.slice(hashes, start.cast("int") + 1, k.cast("int"))))


def pieces(missed: DataFrame) -> DataFrame:
    """m, conv_id, turn, line, depth, h, k, head of the pieces of passages: k lines, head the first one's hash, null where h is of text.

    Stretches are as long as powers of two and begin at each half of their length, so a passage of n lines has
    some 2 n log n hashes to make and any stretch that occurs holds a piece of a third of it at least.
    """
    rows = missed.withColumn("hs", line_hashes(F.col("body"))).where("size(hs) > 1")
    n = F.size("hs")
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.log2(n.cast("double"))).cast("int")), lambda j: F.pow(F.lit(2.0), j).cast("int")), lambda k: k <= n)
    span = lambda i, k: F.struct(i.cast("int").alias("i"), k.cast("int").alias("k"))
    starts = lambda k: F.sequence(F.lit(0), n - k, F.greatest(F.lit(1), F.floor(k / 2).cast("int")))
    spans = F.concat(F.array(span(F.lit(0), n)), F.flatten(F.transform(powers, lambda k: F.concat(F.transform(starts(k), lambda i: span(i, k)), F.array(span(n - k, k))))))
    shape = lambda h, k, head: F.struct(h.alias("h"), k.cast("int").alias("k"), head.cast("string").alias("head"))
    null = F.lit(None)
    # a line's hash is that of its text, as in the index
    stretches = F.transform(spans, lambda p: F.when(p["k"] == 1, shape(F.get(F.col("hs"), p["i"]), F.lit(0), null)).otherwise(shape(window_hash(F.col("hs"), p["i"], p["k"]), p["k"], F.get(F.col("hs"), p["i"]))))
    whole = F.transform(F.filter(F.split("body", PARAGRAPH), lambda x: normal(x) != ""), lambda x: shape(F.md5(normal(x)), F.size(line_hashes(x)), null))
    return rows.select("m", "conv_id", "turn", "line", "depth", F.inline(F.array_distinct(F.concat(stretches, whole))))


def last_before(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(m, line, h, near) of asked (m, line, conv_id, turn, h): the last earlier turn of its conversation in index (h, conv_id, turn), if any.

    Both sides are laid out by turn, in stretches of turns: what a stretch has before a row, else the last of the
    stretches before. So a common line of a long conversation makes no pairs and is not sorted in one task.
    """
    key = ["h", "conv_id", "stretch"]
    events = asked.where("conv_id is not null and turn is not null").select("h", "conv_id", "turn", "m", "line")
    events = events.unionByName(index.select("h", "conv_id", "turn"), allowMissingColumns=True)
    events = events.withColumn("stretch", F.floor(F.col("turn") / STRETCH)).withColumn("there", F.when(F.col("m").isNull(), F.col("turn")))
    # at equal turns what asks comes first
    inside = W.partitionBy(*key).orderBy("turn", F.col("there").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    events = events.withColumn("inside", F.max("there").over(inside))
    stretches = events.groupBy(*key).agg(F.max("there").alias("last"))
    earlier = W.partitionBy("h", "conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    stretches = stretches.select(*key, F.max("last").over(earlier).alias("earlier"))
    found = events.where("m is not null").join(stretches, key).select("m", "line", "h", F.coalesce("inside", "earlier").alias("near"))
    return found.where("near is not null").distinct()


def resolve(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked (m, line, conv_id, turn, h ..) with near (the last earlier turn of its conversation in index) and far (the first message of all, unless it is a later one of its conversation)."""
    near = last_before(asked, index)
    first = index.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = asked.join(near, ["m", "line", "h"], "left").join(first, "h", "left")
    far = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & ~((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") >= F.col("turn"))), F.col("first"))
    return found.withColumn("far", far).drop("first")


def link_pieces(missed: DataFrame, plain: DataFrame) -> DataFrame:
    """m, conv_id, turn, line, depth, to of passages that a piece links: the piece of most lines, in the conversation if it can be."""
    asked = stage(pieces(missed), "quotes-pieces")
    texts = asked.where("head is null").select("h").distinct()
    bodies = F.array_distinct(F.concat(line_hashes(F.col("body")), F.transform(F.split("body", PARAGRAPH), lambda x: F.md5(normal(x)))))
    index = plain.select("conv_id", "turn", F.explode(bodies).alias("h")).join(texts, "h", "left_semi")
    # stretches are only hashed from lines that begin one which is asked for
    lined = plain.select(F.monotonically_increasing_id().alias("p"), "conv_id", "turn", line_hashes(F.col("body")).alias("hs")).where("size(hs) > 1")
    lined = stage(lined, "quotes-lines")
    heads = asked.where("head is not null").select("head", "k").distinct().groupBy("head").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    at = lined.select("p", F.size("hs").alias("n"), F.posexplode("hs").alias("i", "head")).join(heads, "head")
    at = at.select("p", "n", "i", F.explode("ks").alias("k")).where("i + k <= n").groupBy("p").agg(F.collect_list(F.struct("i", "k")).alias("spans"))
    made = lined.join(at, "p").select("conv_id", "turn", F.explode(F.array_distinct(F.transform("spans", lambda s: window_hash(F.col("hs"), s["i"], s["k"])))).alias("h"))
    index = stage(index.union(made.join(asked.where("head is not null").select("h").distinct(), "h", "left_semi")).distinct(), "quotes-piece-index")
    found = resolve(asked, index).where("near is not null or far is not null and k > 0")
    to = F.when(F.col("near").isNotNull(), F.struct("conv_id", F.col("near").alias("turn"))).otherwise(F.col("far"))
    # equal pieces: in the conversation first, its last turn, else the first message
    rank = F.struct(F.col("k"), F.col("near").isNotNull(), F.coalesce("near", F.lit(0).cast("long")), -F.coalesce("far.conv_id", F.lit(0).cast("long")), -F.coalesce("far.turn", F.lit(0).cast("long")))
    return found.groupBy("m", "conv_id", "turn", "line", "depth").agg(F.max_by(to, rank).alias("to"))


def link_quotes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages without quotes, and the links of passages.

    messages: (conv_id, turn, role, text). First result, a row a message: conv_id, turn, role, own_text,
    n_quotes, depth (deepest quote, 0 for none), parent_conv, parent_turn (null for none), thread (turn of the
    message that the chain of parents in this conversation leads to; its own turn for none). Sorted by
    (conv_id, thread, turn) the messages are in reply order, each after its parent.
    Second result: m, conv_id, turn, line, depth, to_conv, to_turn for each linked passage.
    Null text: no quotes and own_text null. Null conv_id or turn: never linked, own thread. Repeated rows are
    messages of their own that share their parent. Among equal candidates the last earlier turn, else the
    smallest (conv_id, turn), is taken.
    """
    rows = stage(messages.select(F.monotonically_increasing_id().alias("m"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"), "quotes-messages")
    # lines are only taken apart where a message quotes
    quoting = F.coalesce(F.col("text").rlike(r"(^|\n)[ \t]*>"), F.lit(False))
    parts = stage(passages(lines(rows.where(quoting))), "quotes-passages")
    quoted = parts.where("depth > 0").withColumn("h", F.md5(normal(F.col("body")))).where(F.length(normal(F.col("body"))) > 0)
    asked = quoted.select("h").distinct()
    plain = rows.where(~quoting).select("conv_id", "turn", F.col("text").alias("body")).union(parts.where("depth = 0").select("conv_id", "turn", "body")).where("body is not null and conv_id is not null and turn is not null")
    bodies = F.array_distinct(F.concat(F.array(normal(F.col("body"))), *(F.transform(F.split("body", p), lambda x: normal(x)) for p in ("\r?\n", PARAGRAPH))))
    index = plain.select("conv_id", "turn", F.explode(bodies).alias("b")).where("b <> ''").select("conv_id", "turn", F.md5("b").alias("h")).join(asked, "h", "left_semi")
    index = stage(index.distinct(), "quotes-index")
    found = stage(resolve(quoted, index).select("m", "conv_id", "turn", "line", "depth", "body", F.when(F.col("near").isNotNull(), F.struct("conv_id", F.col("near").alias("turn"))).otherwise(F.col("far")).alias("to")), "quotes-found")
    links = found.where("to is not null").drop("body").unionByName(link_pieces(found.where("to is null and conv_id is not null and turn is not null"), plain))
    links = links.select("m", "conv_id", "turn", "line", "depth", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"))
    links = stage(links, "quotes-links")
    parent = links.groupBy("m").agg(F.min_by(F.struct("to_conv", "to_turn"), F.struct("depth", "line")).alias("p"))
    own = parts.where("depth = 0").groupBy("m").agg(F.sort_array(F.collect_list(F.struct("line", "body"))).alias("ls")).select("m", F.array_join(F.col("ls.body"), "\n").alias("rest"))
    stats = parts.groupBy("m").agg(F.count(F.when(F.col("depth") > 0, 1)).alias("n_quotes"), F.max("depth").alias("depth"))
    zero = F.lit(0).cast("long")
    out = rows.withColumn("quoting", quoting).join(parent, "m", "left").join(own, "m", "left").join(stats, "m", "left")
    out = out.select("conv_id", "turn", "role", F.when(F.col("quoting"), F.trim(F.coalesce("rest", F.lit("")))).otherwise(F.col("text")).alias("own_text"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce(F.col("depth").cast("long"), zero).alias("depth"), F.col("p.to_conv").alias("parent_conv"), F.col("p.to_turn").alias("parent_turn"))
    heads = threads(out.where("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("up")))
    out = out.join(heads, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("top", "turn")).drop("top")
    return out, links


def threads(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, top) from rows (conv_id, turn, up) with up < turn: follow up to its end by doubling."""
    at = stage(edges.groupBy("conv_id", "turn").agg(F.min("up").alias("top")), "quotes-threads")
    while True:
        step = at.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"))
        moved = stage(at.join(step, ["conv_id", "top"], "left").select("conv_id", "turn", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")), "quotes-threads")
        at = moved.select("conv_id", "turn", "top")
        if moved.where("moved").isEmpty():
            return at


def op7_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """All messages of conversations without quotes, with their parents and threads."""
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))[0]


def _normal_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{SPACE}+', ' ', 'g'))"


def _lines_sql(body: str) -> str:
    """The lines of a text that are not blank, as a list."""
    return f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: {_normal_sql('x')}), lambda x: x <> '')"


def _paragraphs_sql(body: str) -> str:
    return f"string_split_regex({body}, '{PARAGRAPH}')"


def _resolved_sql(asked: str, index: str) -> str:
    """near and far of the rows of a table (id, conv_id, turn, b) by a plain join with an index (conv_id, turn, b)."""
    return f"""SELECT q.*, (SELECT max(i.turn) FROM {index} i WHERE i.b = q.b AND i.conv_id = q.conv_id AND i.turn < q.turn) AS near,
  CASE WHEN q.conv_id IS NOT NULL AND q.turn IS NOT NULL AND NOT (f.first.conv_id = q.conv_id AND f.first.turn >= q.turn) THEN f.first END AS far
  FROM {asked} q LEFT JOIN (SELECT b, min({{'conv_id': conv_id, 'turn': turn}}) AS first FROM {index} GROUP BY b) f ON f.b = q.b"""


_TO = "CASE WHEN near IS NOT NULL THEN {'conv_id': conv_id, 'turn': near} ELSE far END"
ORACLE = f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS m, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text, coalesce(regexp_matches(text, '(^|\\n)[ \\t]*>'), false) AS quoting FROM conversations),
raws AS (SELECT m, conv_id, turn, unnest(string_split_regex(text, '\\r?\\n')) AS raw, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line FROM r WHERE quoting),
ls AS (SELECT m, conv_id, turn, line, length(regexp_replace(regexp_extract(raw, '{MARKS}', 1), '[^>]', '', 'g')) AS depth, regexp_replace(raw, '{MARKS}', '') AS body FROM raws),
st AS (SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY m ORDER BY line) THEN 1 ELSE 0 END AS step FROM ls),
rn AS (SELECT *, sum(step) OVER (PARTITION BY m ORDER BY line) AS run FROM st),
parts AS (SELECT m, conv_id, turn, depth, min(line) AS line, string_agg(body, chr(10) ORDER BY line) AS body FROM rn GROUP BY m, conv_id, turn, run, depth),
plain AS (SELECT row_number() OVER () AS p, * FROM (SELECT conv_id, turn, text AS body FROM r WHERE NOT quoting UNION ALL SELECT conv_id, turn, body FROM parts WHERE depth = 0) WHERE body IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL),
pieced AS (SELECT DISTINCT conv_id, turn, b FROM (SELECT conv_id, turn, unnest(list_concat(list_transform(string_split(body, chr(10)), lambda x: {_normal_sql("x")}), list_transform({_paragraphs_sql("body")}, lambda x: {_normal_sql("x")}))) AS b FROM plain) WHERE b <> ''),
texts AS (SELECT conv_id, turn, {_normal_sql("body")} AS b FROM plain WHERE {_normal_sql("body")} <> '' UNION SELECT * FROM pieced),
q AS (SELECT m, conv_id, turn, line, depth, body, {_normal_sql("body")} AS b FROM parts WHERE depth > 0 AND {_normal_sql("body")} <> ''),
found AS (SELECT *, {_TO} AS dest FROM ({_resolved_sql("q", "texts")})),
missed AS (SELECT m, conv_id, turn, line, depth, body, {_lines_sql("body")} AS hs FROM found WHERE dest IS NULL AND conv_id IS NOT NULL AND turn IS NOT NULL AND len({_lines_sql("body")}) > 1),
powers AS (SELECT 1 << j AS k FROM range(20) g(j)),
spans AS (SELECT m, line, len(hs) AS k, 0::BIGINT AS i FROM missed UNION SELECT m, line, k, s AS i FROM missed, powers, range(1 << 12) g(s) WHERE k <= len(hs) AND s <= len(hs) - k AND (s % greatest(1, k // 2) = 0 OR s = len(hs) - k)),
stretches AS (SELECT x.m, x.conv_id, x.turn, x.line, x.depth, s.k, x.hs[s.i + 1 : s.i + s.k] AS b FROM missed x JOIN spans s USING (m, line) WHERE s.k > 1),
sx AS (SELECT DISTINCT conv_id, turn, {_lines_sql("body")}[i + 1 : i + k] AS b FROM plain, (SELECT DISTINCT k FROM stretches), range(1 << 12) g(i) WHERE i + k <= len({_lines_sql("body")})),
small AS (SELECT DISTINCT m, conv_id, turn, line, depth, k, b FROM (SELECT m, conv_id, turn, line, depth, 0 AS k, unnest(hs) AS b FROM missed UNION ALL SELECT m, conv_id, turn, line, depth, len({_lines_sql("x")}) AS k, {_normal_sql("x")} AS b FROM (SELECT m, conv_id, turn, line, depth, unnest({_paragraphs_sql("body")}) AS x FROM missed)) WHERE b <> ''),
tried AS (SELECT m, conv_id, turn, line, depth, k, near, far FROM ({_resolved_sql("stretches", "sx")}) UNION ALL SELECT m, conv_id, turn, line, depth, k, near, far FROM ({_resolved_sql("small", "pieced")})),
best AS (SELECT m, line, depth, {_TO} AS dest FROM tried WHERE near IS NOT NULL OR far IS NOT NULL AND k > 0
  QUALIFY row_number() OVER (PARTITION BY m, line ORDER BY k DESC, near IS NOT NULL DESC, coalesce(near, 0) DESC, far.conv_id NULLS LAST, far.turn) = 1),
links AS (SELECT m, line, depth, dest FROM found WHERE dest IS NOT NULL UNION ALL SELECT * FROM best),
parent AS (SELECT m, dest FROM links QUALIFY row_number() OVER (PARTITION BY m ORDER BY depth, line) = 1),
own AS (SELECT m, string_agg(body, chr(10) ORDER BY line) AS rest FROM parts WHERE depth = 0 GROUP BY m),
stats AS (SELECT m, count(*) FILTER (depth > 0) AS n_quotes, max(depth) AS depth FROM parts GROUP BY m),
o AS (SELECT conv_id, turn, role, CASE WHEN quoting THEN trim(coalesce(rest, '')) ELSE text END AS own_text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(depth, 0)::BIGINT AS depth, dest.conv_id AS parent_conv, dest.turn AS parent_turn
  FROM r LEFT JOIN parent USING (m) LEFT JOIN own USING (m) LEFT JOIN stats USING (m)),
up AS (SELECT conv_id, turn, min(parent_turn) AS up FROM o WHERE parent_conv = conv_id GROUP BY ALL),
way AS (SELECT conv_id, turn, up AS top FROM up UNION ALL SELECT w.conv_id, w.turn, u.up FROM way w JOIN up u ON u.conv_id = w.conv_id AND u.turn = w.top),
heads AS (SELECT conv_id, turn, min(top) AS top FROM way GROUP BY ALL)
SELECT o.*, coalesce(top, turn) AS thread FROM o LEFT JOIN heads USING (conv_id, turn)
"""
