"""The training-data operators against plain versions, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import json
import unicodedata
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from roadweft.llm import fingerprints, flac, flac_media, jaccard, language, mixing, packing, quality, queries, quotes, substring, token_files, tokens
from roadweft.llm.tokens import Encoder, vocabulary

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def documents():
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from read_parquet('{DATA}/documents.parquet') order by doc_id").fetchall()


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and empty columns, repeated rows and ids, one long text, copies."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " tail", "en", None, None), (3, None, None, None, None), (4, "", "en", "b", 0), (None, base, None, "b", 3), (5, "one two", "en", "b", 7), (5, "one two three", "en", "b", 9), (6, " \t\n ", "en", "a", 4), (7, "x y " * 30000, "en", "a", 1), (8, "ÄÖ ß 日本 \x1c z", "de", "c", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def linked(rows):
    """Component of each row index, by all pairs."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def near_copies():
    """Documents, and groups with links of all strengths that share passages with each other."""
    rows = [(d, t) for d, t, *_ in documents()]
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(200)]
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, 200, rng.integers(0, 6)):
            w[j] = f"n{i}-{j}"
        rows.append((10_000 + i, " ".join(w)))
    for i in range(40):  # a chain: each like the one before, the ends unlike
        rows.append((20_000 + i, " ".join(base[3 * i : 3 * i + 80] + [f"c{j}" for j in range(i, i + 40)])))
    return rows


def all_pairs_groups(rows):
    sets, root = linked(rows)
    low = {}
    for (d, _), r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, d), d)
    return {d: (len(s), low[r]) for (d, _), s, r in zip(rows, sets, root, strict=True)}


@pytest.mark.parametrize("small_blocks", [False, True])
def test_jaccard_equals_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:  # large groups: pivots, groups dealt anew, pairs of blocks
        for name, value in (("BLOCK", 4), ("MANY", 12), ("HEAVY", 64), ("BUCKET", 3000)):
            monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs_groups(rows)


def test_pairs_of_blocks_connect_what_all_pairs_connect(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("MANY", 10_000)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()[200:]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs_groups(rows)


def test_cells_of_the_count_never_outgrow_their_keys(monkeypatch):
    monkeypatch.setattr(jaccard.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = np.random.default_rng(2)
    for sets, keys in ((1, 5), (300, 3), (3000, 40), (70_000, 12), (2000, 90_000)):
        counts = np.bincount(rng.integers(0, sets, keys), minlength=sets)
        raw = jaccard.packed_counts(counts)
        who, n = jaccard.counted(raw)
        back = np.zeros(sets, np.int64)
        back[who] += n
        assert (back == counts).all() and len(raw) <= 2 + 8 * keys
    cells = lambda buckets: [c for b in jaccard._heads_and_keys(5, buckets, "keys")([_batch()]) for c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) if c[0] >= 0]
    keys = {n: sum(len(c[1]) // 4 for c in cells(n)) for n in (4, 4000, 16_000)}
    assert len(set(keys.values())) == 1
    assert all(sum(len(c[2]) for c in cells(n)) <= 10 * keys[n] for n in keys)


def _batch():
    rows = documents()
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, b, "s"), (5, a, "s"), (5, b, "s"), (7, b + " b60", "s"), (None, b, "s"), (8, "", "s"), (8, "", "s"), (9, None, "s"), (9, None, "s"), (5, a, "r"), (None, "x y z", "q"), (None, "x y z", None), (4, "X  y Z", "s")]
    left = jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = [(3, b, "s"), (5, a, "r"), (8, "", "s"), (8, "", "s"), (9, None, "s"), (9, None, "s"), (4, "X  y Z", "s")]
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, want))
    lone = [(None, "x y z", "q"), (None, "x y z", None), (None, "x  y z", "q")]
    assert jaccard.drop_near_copies(spark.createDataFrame(lone, "doc_id long, text string, source string")).count() == 1


def test_tree_traversal_connects_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    sets = []
    for g in range(6):
        base = rng.integers(0, 1 << 62, 150).astype(np.uint64)
        for _ in range(25):
            s = base.copy()
            s[rng.integers(0, 150, 9)] = rng.integers(0, 1 << 62, 9).astype(np.uint64)
            sets.append(np.unique(s))
    forest, plain = jaccard.Forest(len(sets)), jaccard.Forest(len(sets))
    tree = jaccard.build(sets)
    list(jaccard.dual(tree, tree, sets, forest, 80))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if jaccard.similar(sets[i], sets[j], 80)[0]:
            plain.join(i, j)
    split = lambda f: {frozenset(i for i in range(len(sets)) if f.find(i) == r) for r in {f.find(i) for i in range(len(sets))}}
    assert split(forest) == split(plain)


def test_substrings_equal_plain(spark):
    rows = documents()
    first, want = {}, {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if first.setdefault(k, d) < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.op6_substring_dedup(spark, DATA).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == want


def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    got = sorted(map(tuple, mixing.op1_mixing(spark, DATA).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots").collect()), key=repr)
    assert got == sorted(con.execute(mixing.ORACLE).fetchall(), key=repr)
    assert all(r[4] <= 2 * r[1] for r in got)


def van_der_corput(n, bits):
    return sum((n >> k & 1) << (bits - 1 - k) for k in range(bits))


@pytest.mark.parametrize("targets", [(5000.5, 700.0, 0.0, 90_000.0, 1.0), (512.0,), (511.0, 513.0), (0.0, 0.0), (40_000.0, 20_000.0, 20_000.0)])
def test_schedule_keeps_the_shares_in_every_stretch(spark, targets):
    goals = spark.createDataFrame([(i, float(t)) for i, t in enumerate(targets)], "rank long, target double")
    rows = sorted((r["slot"], r["rank"], r["block_no"], r["words"]) for r in mixing.schedule(goals).collect())
    blocks = [-(-int(t) // 512) for t in targets]
    ends = list(itertools.accumulate(blocks))
    bits = max(sum(blocks) - 1, 0).bit_length()
    want, seen = [], [0] * len(targets)
    for slot in range(1 << bits if sum(blocks) else 0):
        point = van_der_corput(slot, bits)
        if point < sum(blocks):
            rank = next(i for i, e in enumerate(ends) if point < e)
            want.append((slot, rank, seen[rank], min(512, int(targets[rank]) - 512 * seen[rank])))
            seen[rank] += 1
    assert rows == want
    taken = [0] * len(targets)
    for n, (_, rank, _, _) in enumerate(rows, 1):
        taken[rank] += 1
        assert all(abs(x - n * b / sum(blocks)) <= 1 + bits / 2 for x, b in zip(taken, blocks, strict=True))
    assert [sum(w for _, r, _, w in rows if r == i) for i in range(len(targets))] == [int(t) for t in targets]


def test_mixed_documents_come_in_the_order_of_their_slots(spark, awkward):
    docs = awkward.selectExpr("*", "1 as c0", "2 as file", "3 as `row`")
    rows = mixing.mixed_documents(docs).collect()
    sizes = {}
    for r in awkward.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    goals = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        taken[r["source"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert taken == {s: int(t) for s, t in goals.items()}
    assert mixing.mixed_documents(docs).collect() == rows and rows[0].asDict().keys() == set(docs.columns)


def test_mixed_documents_do_not_depend_on_files(spark):
    rows = [(i, " ".join(f"{x}{n}" for n in range(90)), x) for i, x in [*((None, f"n{k}_") for k in range(12)), *((7, f"r{k}_") for k in range(12))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("source", F.lit("a"))
    want = mixing.mixed_documents(docs.repartition(3)).collect()
    assert all(mixing.mixed_documents(docs.repartition(n)).collect() == want for n in (1, 4))


PARTS = ["a", "b", "Z", "s", "'", "'s", "'re", "'LL", "1", "23", ".", "!", "-", "_", "é", "É", "×", "÷", "ß", "\u0301", "\u0338", "中", "日本", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u200b", "\u2003", "\u3000", "½", "²", "Ⅷ", "٣", "İ", "ı", "ſ", "ﬁ", "<|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "|>", "don't", "'ve", "😀", "\ufeff", "\x00", "ª", "¿", "«"]


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, keeps, special_as_text):
    rng = np.random.default_rng(11)
    made = ["".join(PARTS[i] for i in rng.integers(0, len(PARTS), n)) for n in rng.integers(0, 14, 4000)]
    texts = [t for _, t, *_ in documents()] + ["", "a  b", "  x\n\n y \t z ", "don't I'LL é̈a ", "a <|endoftext|> b", "<|startoftext|>x", " \n\t a", "\n\n", "İ ß a​b", *made]
    whole = Tokenizer.from_file(vocabulary(name))
    if special_as_text:
        whole.encode_special_tokens = True
    model = Encoder(vocabulary(name), keeps, special_as_text)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in model.encode([t.encode() for t in texts])] == want


@pytest.mark.parametrize("stage", [language.keep_known, jaccard.drop_near_copies, substring.cut_repeats])
def test_later_operators_let_go_of_the_encoder_in_a_worker(spark, awkward, monkeypatch, stage):
    kernels, kind = [], type(awkward)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *rest: kernels.append(f) or real(self, f, *rest))
    stage(awkward)
    assert kernels
    for kernel in kernels:  # each may be the first to run in a worker that has packed
        tokens.encoder(vocabulary("word_bpe_49k.json"), False).encode([b"some words"])
        next(kernel(iter([])), None)
        assert not tokens._encoders and len(tokens.hashing.BYTES.up) == 1


def test_encoder_forgets_pieces_and_still_agrees(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 500)
    monkeypatch.setattr(tokens, "BATCH", 3000)
    texts = [t for _, t, *_ in documents()]
    name = vocabulary("byte_bpe_50k.json")
    want = [e.ids for e in Tokenizer.from_file(name).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(name, True).encode([t.encode() for t in texts])] == want


def test_packing_covers_each_id_once(spark):
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t, *_ in documents()}
    docs, sequences = {}, {}
    for r in packing.op3_packing(spark, DATA).collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (zlib.crc32(piece.tobytes()), len(ids[r["doc_id"]])) == (r["ids_crc32"], r["doc_tokens"])
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    gapless = lambda parts: [s for s, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1]
    assert docs.keys() == ids.keys() and all(gapless(v) and sum(n for _, n in v) == len(ids[d]) for d, v in docs.items())
    totals = [sum(n for _, n in v) for v in sequences.values()]
    assert all(map(gapless, sequences.values())) and all(n <= 2048 and n & (n - 1) == 0 for n in totals)


def test_token_files_round_trip(spark, tmp_path):
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    start, want = 0, {}
    for d, t, *_ in documents():
        ids = np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_files.op8_token_output(spark, DATA).collect()} == want
    path = f"file://{tmp_path}/ids"
    token_files.write_tokens(spark.read.parquet(f"{DATA}/documents.parquet"), path)
    some = token_files.read_tokens(spark, path, ["doc_id", "start"], 10, 20).collect()
    assert {r["doc_id"]: r["start"] for r in some} == {d: want[d][0] for d in range(10, 21)}


def test_flac_round_trip_and_checksums():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), b"a" * 640, rng.integers(0, 256, 5000, np.uint8).tobytes(), bytes([0, 255] * 3000), *(flac_media.padded(t.encode()) for _, t, *_ in documents()[:50])]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    raw, info = streams[-1], flac.parse_stream(streams[-1])
    assert flac.decode([raw[:4] + b"\x80" + raw[5:42] + raw[info.audio :]]) == [payloads[-1]]  # without a seek table
    broken = bytearray(raw)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def test_media_query(spark):
    texts = {d: (t or "").encode() for d, t, *_ in documents()}
    streams = {r["doc_id"]: bytes(r["media"]) for r in flac_media.encode_media(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    for r in flac_media.op5_media_flac(spark, DATA).collect():
        p = texts[r["doc_id"]]
        p += bytes(-len(p) % 64 or 64 * (not p))
        media = streams[r["doc_id"]]
        samples = [x - 128 for x in p]
        steps = [abs(y - x) for x, y in itertools.pairwise(samples)]
        zero = sum((x >= 0) != (y >= 0) for x, y in itertools.pairwise(samples))
        feature = f"n={len(p)};mean={sum(samples) / len(p):.6f};rms={(sum(x * x for x in samples) / len(p)) ** 0.5:.6f};step={sum(steps) / len(p):.6f};zero={zero};peak={max(map(abs, samples))}"
        want = (len(texts[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, -(-len(p) // flac.BLOCK), (len(p) - 1) // flac.BLOCK * flac.BLOCK)
        assert tuple(r)[1:] == want


def test_pcm_blocks_can_be_sought(spark):
    long = bytes(np.random.default_rng(4).integers(97, 123, 3 * flac.BLOCK + 5, np.uint8)).decode()
    docs = spark.createDataFrame([(1, long), (2, ""), (3, None), (3, "short"), (None, "x" * 100)], "doc_id long, text string")
    media = flac_media.encode_media(docs.selectExpr("*", "1 as media", "2 as n_bytes"))
    blocks = sorted(map(tuple, flac_media.pcm_blocks(media.union(media.limit(1).selectExpr("9L", "text", "n_bytes", "cast(null as binary)"))).collect()), key=repr)
    whole = {(r["doc_id"], r["text"]): bytes(r["media"]) for r in media.collect()}
    assert {b[0] for b in blocks} == {1, 2, 3, None} and len([b for b in blocks if b[0] == 1]) == 4
    for (doc_id, text), raw in whole.items():
        info = flac.parse_stream(raw)
        mine = [b for b in blocks if b[0] == doc_id and (doc_id != 3 or bytes(b[5]) == flac_media.padded((text or "").encode()))]
        payload = flac_media.padded((text or "").encode())
        for _, i, sample, byte, n, pcm in mine:
            assert sample == i * flac.BLOCK and bytes(pcm) == payload[sample : sample + n]
            assert raw[info.audio + byte : info.audio + byte + 2] in (b"\xff\xf8", b"\xff\xf9")  # a frame begins here
        assert b"".join(bytes(b[5]) for b in mine) == payload


def plain_chunks(raw):
    """Chunk digests and lengths, byte by byte."""
    mask, h, out, at = (1 << 32) - 1, 0, {}, 0
    ends, hashes = [], []
    for b in raw:
        h = ((h << 1) + int(fingerprints.GEAR[b])) & mask
        hashes.append(h)
    for i in range(len(raw)):
        size = i + 1 - at
        zero = 8 if size < 64 else 4
        if size >= 16 and (hashes[i] >> (32 - zero) == 0 or size == 256) and len(raw) - at > 16:
            ends.append(i + 1)
            at = i + 1
    if at < len(raw):
        ends.append(len(raw))
    at = 0
    for end in ends:
        out[xxhash.xxh3_64_intdigest(raw[at:end]) >> 16] = end - at
        at = end
    return out


def test_fingerprints_follow_the_next_document(spark):
    rows = sorted(documents(), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.op9_fingerprints(spark, DATA).collect()}
    text = lambda chunks: "".join(f"{d:012x}{n:03x}" for d, n in sorted(chunks.items()))

    def alike(a, b):
        if not a or not b:
            return 1.0 if not a and not b else 0.0
        return sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values()))

    for (d, t, *_), (_, after, *_) in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        sets = [plain_chunks(x.encode()) for x in (t, new, after)]
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), text(sets[0]), text(sets[1]), alike(sets[0], sets[1]), alike(sets[0], sets[2]))
        assert tuple(got[d])[1:] == pytest.approx(want)


def test_chunks_survive_a_shift():
    text = documents()[3][1].encode() * 3
    assert fingerprints.likeness(fingerprints.chunk_set(text), fingerprints.chunk_set(b"some words before " + text)) > 0.8


def test_language_on_held_out_documents(spark):
    langs = {d: x for d, _, x, *_ in documents()}
    rows = language.op10_language_id(spark, DATA).where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows) and len(rows) == sum(zlib.crc32(str(d).encode()) % 4 == 2 for d in langs)
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_language_is_the_nearest_centroid(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    keep = lambda b: b if b >= 128 or 97 <= b <= 122 else 32

    def grams(text):
        letters = []
        for b in map(keep, b" " + text.lower().encode() + b" "):
            if b != 32 or not letters or letters[-1] != 32:
                letters.append(b)
        out = np.zeros(language.DIMS)
        for n in (1, 2, 3):
            for i in range(len(letters) - n + 1):
                code = 0
                for b in letters[i : i + n]:
                    code = (code * 257 + b) & 0xFFFFFFFF
                out[((code * 2654435761 & 0xFFFFFFFF) ^ n * 40503) >> 19] += 1
        return out

    texts = [t for _, t, lang, *_ in documents() if t and lang]
    df = np.sum([grams(r["text"]) > 0 for r in docs.where(~language.held_out() & F.col("lang").isNotNull()).collect() if r["text"] and any(c.isalpha() for c in r["text"])], axis=0)
    n = docs.where(~language.held_out() & F.col("lang").isNotNull()).count()
    assert np.allclose(model.idf, np.log((1 + n) / (1 + np.maximum(df, 0))) + 1, atol=1e-4)
    got = {r["doc_id"]: r for r in language.classify(docs, model).collect()}
    for d, t, *_ in documents()[:60]:
        v = np.sqrt(grams(t)) * model.idf
        cos = model.centroids @ v / max(np.linalg.norm(v), 1e-9)
        assert got[d]["lang_pred"] == model.langs[int(np.argmax(cos))] and got[d]["score"] == pytest.approx(cos.max(), abs=1e-4)
        assert got[d]["rejected"] == (got[d]["score"] < model.least)
    assert texts


def test_texts_without_letters_have_no_language(spark):
    model = language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    texts = [None, "", "½", "²³", "③ 12", "Ⅷ", "_-_", "٣", "a", "é", "日", "ª", "ǅ"]
    rows = language.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    letter = {t for t in texts if t and any(unicodedata.category(c).startswith("L") for c in t)}
    assert {r["text"] for r in rows if r["lang_pred"] != "und"} == letter and all(r["score"] == 0 and r["rejected"] for r in rows if r["lang_pred"] == "und")


def test_samples_are_bounded(spark):
    rows = [(1, "same text here", "en")] * 300 + [(i, f"text number {i} of many", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    language_rows = language.k_means
    try:
        language.k_means = lambda x, k, rounds: seen.append(len(x)) or language_rows(x, k, rounds)
        language.fit(docs, sample=50)
    finally:
        language.k_means = language_rows
    assert 0 < seen[0] <= 50


def test_quality_on_held_out_documents(spark):
    data = DATA.replace("0.001", "0.01")
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{data}/labels.parquet')").fetchall())
    rows = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in quality.op4_quality_classifier(spark, data).where("held_out").collect() if r["doc_id"] in labels]
    good, bad = ([s for s, y, _ in rows if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(p == (s >= 0.3) for s, _, p in rows) and np.mean([p == y for _, y, p in rows]) > 0.95


def test_risk_of_the_quality_network_falls(spark):
    """The non-negative risk, written out, is lower after training than with no rounds, and its gradient agrees with differences."""
    rng = np.random.default_rng(8)
    p, u = rng.normal(1, 1, (200, quality.N_FEATURES)), np.concatenate([rng.normal(1, 1, (150, quality.N_FEATURES)), rng.normal(-1, 1, (150, quality.N_FEATURES))])

    def risk(net, prior=0.5):
        sp, su = net.score(p), net.score(u)
        return prior * (1 - sp).mean() + max(0.0, su.mean() - prior * sp.mean())

    assert risk(quality.train(p, u, 0.5, 200)) < 0.2 < risk(quality.train(p, u, 0.5, 0))


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello  there\nSecond line"), (1, 1, "a", "> hello there\n> second line\nYes, indeed"), (1, 2, "u", "> > Hello there\n>yes, indeed\nWhy?"), (2, 0, "u", ">Why?\nbecause"), (2, 1, "a", None), (None, None, None, "> x"), (3, 5, "u", ">> unknown"), (3, 6, "u", "")]
    out, links = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {(r["conv_id"], r["turn"]): (r["own_text"], r["depth"], r["parent_conv"], r["parent_turn"], r["thread"]) for r in out.collect()}
    assert got[1, 1] == ("Yes, indeed", 1, 1, 0, 0) and got[1, 2] == ("Why?", 2, 1, 1, 0) and got[2, 0] == ("because", 1, 1, 2, 0)
    assert got[2, 1] == (None, 0, None, None, 1) and got[3, 5] == ("", 2, None, None, 5) and got[None, None][2] is None
    assert links.count() == 4


def test_parts_of_messages_are_linked(spark):
    body = "Dear all\n\nfirst line\nsecond line\nthird line\nfourth line\n\nShort one\n\nBye"
    quote = lambda *ls: "\n".join("> " + x for x in ls) + "\nyes"
    rows = [
        (1, 0, "u", body), (1, 1, "a", "second line\nthird line\nunlike"),
        (1, 2, "a", quote("first line", "second line")),  # two lines of a paragraph
        (1, 3, "a", quote("first line", "second line", "third line", "fourth line")),  # a paragraph
        (1, 4, "a", quote("first line second", "line third line fourth line")),  # the same, broken anew
        (1, 5, "a", quote("Second  line", "third line", "fourth line")),  # all three, though a later message has two
        (1, 6, "a", quote("fourth line", "", "Short one")),  # across paragraphs
        (1, 7, "a", quote("first line", "second line", "[...]", "fourth line", "Short one", "Bye")),  # cut; the longer part counts
        (1, 8, "a", quote("Short one", "not theirs")),  # one line, in the conversation
        (2, 0, "a", quote("second line", "third line", "fourth line")),  # from another conversation
        (2, 1, "a", quote("Bye", "not theirs")), (2, 2, "a", quote("never", "written")),
    ]
    out, _ = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in out.collect()}
    nothing = [(1, 0), (1, 1), (2, 1), (2, 2)]
    assert got == {k: (None, None) if k in nothing else (1, 0) for k in got}


def made_up_replies(seed, n_conversations=25, n_turns=9):
    """Messages that quote earlier ones, whole, in part and nested, with repeats, nulls and quotes of nothing."""
    rng = np.random.default_rng(seed)
    words = ["yes", "No", "the  cat", "sat", "on", "a mat", "why?", "Ünder", "x"]
    pick = lambda n: [" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(n)]
    rows = []
    for c in range(n_conversations):
        bodies = []
        for t in range(n_turns):
            lines = []
            for _ in range(rng.integers(0, 3)):
                source = bodies if bodies and rng.random() < 0.7 else [r[3] for r in rows if r[3]] or [""]
                old = source[rng.integers(len(source))].split("\n")
                i = rng.integers(0, len(old))
                quoted = old[i : i + rng.integers(1, 6)] if rng.random() < 0.6 else old
                quoted = [x.upper() if rng.random() < 0.2 else x for x in quoted] + pick(1) * int(rng.random() < 0.2)
                lines += [rng.choice(["> ", ">", " > "]) + x for x in quoted]
                lines += pick(rng.integers(0, 2))
            lines += pick(rng.integers(0, 4)) + [""] * int(rng.random() < 0.3) + pick(rng.integers(0, 3))
            text = None if rng.random() < 0.04 else ("\r\n" if rng.random() < 0.1 else "\n").join(lines)
            if text:
                bodies.append(text.replace("\r", ""))
            rows.append((None if rng.random() < 0.03 else c, None if rng.random() < 0.03 else t, rng.choice(["u", "a"]), text))
    return rows + rows[:: n_conversations * 3]


@pytest.mark.parametrize(("seed", "stretch"), [(1, 4096), (2, 3), (3, 1), (None, 4096)])
def test_quotes_equal_sql(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(quotes, "STRETCH", stretch)
    rows = made_up_replies(seed) if seed else []
    messages = spark.createDataFrame([(*r[:2], None if r[2] is None else str(r[2]), r[3]) for r in rows], "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    arrow = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int32()), "role": pa.array([r[2] and str(r[2]) for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())})
    con.register("conversations", arrow)
    names = ["conv_id", "turn", "role", "own_text", "n_quotes", "depth", "parent_conv", "parent_turn", "thread"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({quotes.ORACLE})").fetchall(), key=repr)
    got = sorted(map(tuple, quotes.link_quotes(messages.selectExpr("*", "1 as m", "2 as line"))[0].select(*names).collect()), key=repr)
    assert got == want
    assert not seed or sum(r[6] is not None for r in got) > 50


@pytest.mark.parametrize("which", ["awkward", "empty"])
def test_odd_tables(request, which):
    docs = request.getfixturevalue(which)
    n = docs.count()
    assert jaccard.jaccard_groups(docs).count() == n
    assert substring.remove_repeats(docs).count() == n
    assert packing.pack_documents(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert fingerprints.fingerprint_neighbours(docs).count() == n
    assert flac_media.read_media(flac_media.encode_media(docs)).count() == n
    clash = docs.selectExpr("*", "text as lang_pred", "1 as score")
    assert language.classify(clash, language.fit(docs)).count() == n
    assert quality.classify(docs, quality.fit(docs, docs.selectExpr("doc_id", "1 as quality"))).count() == n
    path = f"file://{request.getfixturevalue('tmp_path')}/t"
    token_files.write_tokens(docs, path)
    assert token_files.read_tokens(docs.sparkSession, path).count() == n
    assert mixing.mixed_documents(docs).columns == docs.columns
    extra = docs.selectExpr("*", "1 as kept", "2 as node", "3 as row", "4 as w")
    for step in (jaccard.drop_near_copies, substring.cut_repeats, language.keep_known, mixing.mixed_documents):
        assert step(extra).columns == extra.columns
        step(extra).collect()


def test_pipeline_keeps_what_plain_steps_keep(spark):
    """Each stage against a plain version over what the stage before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    everything = {d: (t, lang, source, n) for d, t, lang, source, n in documents()}
    kept = corpus_pipeline.language(spark, docs, DATA).collect()
    rejected = {r["doc_id"] for r in language.classify(docs, language.fit(docs.where(~language.held_out()))).where("rejected").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in kept} == {d: v for d, v in everything.items() if d not in rejected}
    _, root = linked([(r["doc_id"], r["text"]) for r in kept])
    low = {}
    for r, c in zip(kept, root, strict=True):
        low[c] = min(low.get(c, r["doc_id"]), r["doc_id"])
    left = corpus_pipeline.near_copies(spark, spark.createDataFrame(kept, docs.schema), DATA).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in left} == {d: everything[d] for d in low.values()}
    first, want = {}, {}
    for d in sorted(low.values()):
        w = (everything[d][0] or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else everything[d][0]
    cut = corpus_pipeline.substrings(spark, spark.createDataFrame(left, docs.schema), DATA).collect()
    assert {r["doc_id"]: r["text"] for r in cut} == want and all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] != everything[r["doc_id"]][0])
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(cut, docs.schema), DATA).collect()
    sizes, taken = {}, {}
    for r in cut:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].encode().split())
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].encode().split())
        assert " ".join(r["text"].split()) in " ".join(want[r["doc_id"]].split())
    goals = {r["source"]: int(r["target"]) for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert taken == {s: t for s, t in goals.items() if t}
    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokens_of = Counter((r["doc_id"], len(whole.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    packed = corpus_pipeline.packing(spark, spark.createDataFrame(mixed, docs.schema), DATA).collect()
    got = {}
    for r in packed:
        got[r["doc_id"], r["doc_tokens"]] = got.get((r["doc_id"], r["doc_tokens"]), 0) + r["length"]
    assert got == {k: k[1] * m for k, m in tokens_of.items()}


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py" and json.dumps([n for n, _ in corpus_pipeline.STAGES])
