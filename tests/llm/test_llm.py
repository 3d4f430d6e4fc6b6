"""The operators for training data against brute force, planted cases and odd inputs."""

import base64
import hashlib
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evenkeel import scratch
from evenkeel.llm import bpe, components, copies, decontaminate, langid, line_dedup, lm_score, quality, queries, simhash, token_files, toxicity, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, version string, n_removed string"
WORD_BPE, BYTE_BPE = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    words = " ".join(f"w{i % 701}x" for i in range(20_000))
    rows = [
        (1, "", None, None, None, None, None), (2, None, "en", "s", 0, 1, "v"), (None, None, None, None, None, None, None),
        (3, words, "en", "s", 1, 0, "v"), (4, words, "en", "s", 1, 0, "v"), (5, "one two three", "fr", None, 3, 1, None),
        (5, "one two three", "fr", None, 3, 1, None), (6, "   \n\t ", "de", "s", 1, 1, "v"), (None, "a b c d e f g h i j", None, "s", 2, 0, "v"),
    ]
    rows = [(*r, "mine") for r in rows]
    return spark.createDataFrame(rows, SCHEMA)


def run_all(docs, spark, items, labels):
    """Every operator over one table, by name."""
    from evenkeel.scratch import new_folder

    def token_rows():
        path = new_folder(spark, "odd-tokens")
        token_files.write_token_files(docs, path, BYTE_BPE)
        return token_files.checksums(token_files.read_token_files(spark, path))

    def warc_rows():
        path = new_folder(spark, "odd-warc")
        warc.write_warc(docs, path, id_col="doc_id", payload_col="text")
        return warc.read_warc(spark, path)

    return {
        1: decontaminate.contaminated(docs, items), 2: token_rows(), 3: simhash.simhash_groups(docs), 4: warc_rows(),
        5: bpe.digests(bpe.bpe_decode(bpe.bpe_encode(docs, WORD_BPE), WORD_BPE)), 6: line_dedup.dedup_lines(docs), 7: langid.identify(docs),
        8: toxicity.toxicity(docs, labels), 9: lm_score.lm_scores(docs, block_bytes=64), 10: quality.quality_rules(docs, labels),
        "stage10": quality.keep_good(docs, labels), "stage6": corpus_pipeline.line_stage(spark, docs, SF), "keep_first": simhash.keep_first(docs),
        "stage3": copies.keep_first(docs), "stage1": decontaminate.without_contaminated(docs, items), "stage5": corpus_pipeline.tokens_stage(spark, docs, SF),
    }


def test_odd_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(0, "one two"), (None, None), (1, "w1x w2x w3x w4x w5x w6x w7x w8x")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, 0), (5, None)], "doc_id long, label int")
    rows = {k: df.collect() for k, df in run_all(odd, spark, items, labels).items()}
    counts = {1: 3, 2: 9, 3: 9, 4: 9, 5: 9, 6: 9, 7: 9, 8: 9, 9: 7, 10: 9, "stage10": 0, "stage6": 8, "keep_first": 8, "stage3": 8, "stage1": 5, "stage5": 9}
    assert {k: len(v) for k, v in rows.items()} == counts
    # Of two words only, an item is searched as it is.
    assert {(r.doc_id, r.item_id) for r in rows[1]} == {(3, 1), (4, 1), (5, 0)}
    assert {r.n_removed for r in rows["stage6"]} == {"mine"} and sorted(r.n_removed for r in rows[6]) == [0] * 8 + [1]
    assert {r.lang_pred for r in rows[7] if r.doc_id in (1, 2, 6)} == {"und"}
    for k, df in run_all(odd.limit(0), spark, items.limit(0), labels.limit(0)).items():
        assert df.count() == 0, k


def test_fingerprints_and_groups(spark, texts):
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.read.parquet(f"{SF}/documents.parquet"), chunk=3).collect()}
    import xxhash

    def brute(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {d: brute(t) for d, t in texts.items()}
    root = {d: d for d in fp}
    for _ in range(len(fp)):
        new = {a: min(root[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3) for a in fp}
        if new == root:
            break
        root = new
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fp[d]:016x}", root[d]) for d in fp}


def test_digests_in_one_pass(spark, texts, odd):
    for docs in (odd, spark.createDataFrame([*texts.items(), (None, "<|endoftext|> Ünï 東京 <|x"), (1, None)], "doc_id long, text string")):
        whole = bpe.digests(bpe.bpe_decode(bpe.bpe_encode(docs, WORD_BPE), WORD_BPE))
        got = bpe.bpe_digests(docs, WORD_BPE)
        assert got.schema.names == whole.schema.names
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_bit_planes_find_all_near():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 7))))) for b in base for _ in range(27)], np.uint64)
    planes = simhash.bit_planes(fps)
    for q in fps.tolist():
        assert simhash.near(planes, len(fps), q, 3).tolist() == [i for i, f in enumerate(fps.tolist()) if (f ^ q).bit_count() <= 3]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(None, 3), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_trie_encoding_equals_the_library(texts):
    library, encoder = Tokenizer.from_file(WORD_BPE), bpe.TrieEncoder(WORD_BPE)
    rng = random.Random(2)
    strange = ["".join(rng.choice("aabcdeithnsrol'  \n\t.,é0ñ<|>/wÉßΣ\x00\x1c中ก") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    all_texts = [*(t or "" for t in texts.values()), *strange, "x <|startoftext|> y<|endoftext|>", "<|endoftext|"]
    for text, ids in zip(all_texts, encoder.encode(all_texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == want
        assert " ".join(encoder.tokens[i] for i in want) == library.decode(want, skip_special_tokens=False)


def test_token_files(spark, texts, folder):
    path, library = folder("tokens"), Tokenizer.from_file(BYTE_BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, " a<|endoftext|>  b \n c")], "doc_id long, text string"), True)
    token_files.write_token_files(docs, path, BYTE_BPE)
    got = {r.doc_id: r for r in token_files.checksums(token_files.read_token_files(spark, path)).collect()}
    start = 0
    for d, t in sorted({**texts, 10**6: None, 10**6 + 1: " a<|endoftext|>  b \n c"}.items()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read_token_files(spark, path, spark.createDataFrame([(3,), (10**6,)], "doc_id long")).collect()
    assert {r.doc_id: len(r.ids) for r in some} == {3: got[3].n_tokens, 10**6: 1}


def test_token_files_hold_little(spark, folder, monkeypatch):
    """Rows go to Python by the hundred, one process a task reads back, and caches are given up."""
    path, setting, sent = folder("tokens"), "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = setting in spark.conf.getAll
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, kind, of=frame.mapInArrow: (sent.append(spark.conf.get(setting)), of(self, f, kind))[1])
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id, ' of', char(97 + id % 26), ' ', id) AS text")
    token_files.write_token_files(docs.coalesce(1), path, BYTE_BPE)
    assert int(sent[-1]) <= 1000
    assert (setting in spark.conf.getAll) == before
    got = token_files.read_checksums(spark, path)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(got.collect()) == sorted(token_files.checksums(token_files.read_token_files(spark, path)).collect())
    some = token_files.read_checksums(spark, path, spark.createDataFrame([(7,), (10**6,)], "doc_id long")).collect()
    assert [r.doc_id for r in some] == [7] and some[0] in got.collect()


def test_token_encoder_forgets_and_equals_the_library(texts, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 2000)
    library, encoder, rng = Tokenizer.from_file(BYTE_BPE), token_files.CachedEncoder(BYTE_BPE), random.Random(4)
    strange = ["".join(rng.choice("aabcdeithnsrol'  \n\t.,é0ñ<|>/wÉßΣ\x00\x1c\x85\xa0\u2003\u3000中ก") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    words = [" ".join("".join(rng.choices("abcdeéñ", k=7)) + rng.choice(["", ".", "!,"]) for _ in range(100)) for _ in range(90)]
    for some in (strange, [t or "" for t in texts.values()][:300], words[:30], words[30:60], words[60:], ["", "\n", " ", "a\n", "a ", "x<|endoftext|> y"], []):
        for text, ids in zip(some, encoder.encode(pa.array(some, pa.string())), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    encoder.encode(pa.array(words[:30]))
    assert len(encoder.cache) < 2000 + 2 * 3000
    encoder.forget()
    assert 2900 < len(encoder.cache) <= 3001
    # Words are put together for the tokenizer only where its vocabulary keeps them apart.
    apart, encoder.together = encoder.together, 1
    encoder.cache.clear()
    one_by_one = encoder.encode(pa.array(words))
    encoder.together = apart
    encoder.cache.clear()
    assert apart > 1 and encoder.encode(pa.array(words)) == one_by_one


def test_token_blocks_fill_across_batches(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 100)
    rng = random.Random(6)
    rows = [(i, "é" * rng.choice([0, 3, 20, 90])) for i in range(400)]
    cuts = [0, 1, 1, 50, 51, 300, 400]
    batches = [pa.record_batch([pa.array([d for d, _ in rows[a:b]], pa.int64()), pa.array([t for _, t in rows[a:b]], pa.string())], names=["doc_id", "text"]) for a, b in zip(cuts, cuts[1:])]
    blocks = [list(zip(d.to_pylist(), t.to_pylist())) for d, t in token_files._filled(iter(batches))]
    assert [r for b in blocks for r in b] == rows
    sizes = [[len(t.encode()) for _, t in b] for b in blocks]
    assert all(sum(x) >= 100 for x in sizes[:-1]) and all(sum(x[:-1]) < 200 for x in sizes)
    assert list(token_files._filled(iter([]))) == []


def test_warc_with_records_inside_payloads(spark, folder):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nx"
    rows = [(i, "u\r\nx", inner * (i % 4) if i % 3 else None) for i in range(30)] + [(50 + i, None, "é" * 90_000 + inner * 3000 + str(i)) for i in range(2)]
    rows += [(None, None, ""), (0, "u", None)]
    path, before = folder("warc"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for p, _, h in rows:
        first[h or ""] = min(first.get(h or "", p), p, key=lambda x: (x is not None, x or 0)) if (h or "") in first else p
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = [(p, len((h or "").encode()), digest(h or ""), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in rows]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert all(r.intact for r in got)


def test_warc_with_a_long_url_in_the_middle(spark, folder):
    rows = [(i, "http://x/" + "u" * (100_000 if i == 5 else 20), f"page {i}") for i in range(12)]
    path = folder("warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_warc(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes, r.intact) for r in got) == [(i, len(h), True) for i, _, h in rows]


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(8, 11))] for _ in range(12)]

    def edited():
        w = list(rng.choice(base))
        k = rng.randrange(len(w))
        return rng.choice([w, w[:k] + w[k + 1 :], w[:k] + ["z"] + w[k:], w[:k] + ["y"] + w[k + 1 :]])

    docs = [(d, "\n".join(" ".join(edited()) for _ in range(4))) for d in range(30)]
    got = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    lines = [((d, i), x.split()) for d, t in docs for i, x in enumerate(t.split("\n"))]
    lines = [(p, w) for p, w in lines if len(w) >= line_dedup.MIN_WORDS]
    assert got == {p for i, (p, w) in enumerate(lines) if any(near(w, v) for _, v in lines[:i])}


def test_repeated_words_by_brute_force():
    rng = random.Random(1)
    for n in (0, 7, 8, 9, 40, 300):
        for k in (1, 2, 5):
            words = [str(rng.randrange(k)).encode() for _ in range(n)]
            windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
            hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
            assert quality.repeated_words(words) == len(hit)


def test_short_items_and_texts_without_an_id(spark):
    rows = [(None, "intro one two three four five six seven end"), (1, "it says alpha beta gamma delta twice"), (1, "clean"), (2, "alpha beta gamma"), (3, "Beta, gamma!"), (None, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, "one two three four five six seven"), (1, "alpha beta gamma delta"), (2, "gamma"), (3, "  ")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item, r.containment) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1, 1, 1, 1.0), (1, 2, 1, 1, 1.0), (2, 2, 1, 1, 1.0), (3, 2, 1, 1, 1.0)}
    kept = decontaminate.without_contaminated(docs, items).collect()
    assert [tuple(r) for r in kept] == [(1, "clean"), (None, "clean")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text TEXT)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text TEXT)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [tuple(r) for r in items.collect()])
    assert set(con.sql(decontaminate.SQL).fetchall()) == found


def test_no_language_is_lost(spark):
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 960)]
    speak = lambda k: " ".join("".join(rng.choice(letters[8 * k : 8 * k + 8]) for _ in range(4)) for _ in range(12))
    rows = [(k * 1000 + i, f"l{k}", speak(k)) for k in range(120) for i in range(200 if k < 100 else 10)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert set(model.langs) == {f"l{k}" for k in range(120)}
    found = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = {r.rare: r.right for r in found.groupBy(F.expr("CAST(substr(lang, 2) AS INT) >= 100").alias("rare")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).collect()}
    assert right[False] > 0.8 and right[True] > 0.3


def test_archives_have_the_mandatory_fields(spark, folder):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (2, "http://c", "y"), (3, None, None)], "page_id long, url string, html string")
    path = folder()
    warc.write_warc(pages.coalesce(1), path, date="2024-01-31T12:00:00Z")
    import glob
    import re

    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))
    heads = [h.split(b"\r\n\r\n")[0].decode().split("\r\n") for h in data.split(b"WARC/1.1\r\n")[1:]]
    fields = [dict(line.split(": ", 1) for line in h) for h in heads]
    ids = [f["WARC-Record-ID"] for f in fields]
    assert len(set(ids)) == 4 and all(re.fullmatch(r"<urn:page:\d+:[A-Z2-7]{32}>", i) for i in ids)
    assert {f["WARC-Date"] for f in fields} == {"2024-01-31T12:00:00Z"}
    (again,) = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert again["WARC-Refers-To"] in ids and again["WARC-Profile"] == warc.PROFILE
    rows = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.intact) for r in warc.read_warc(spark, path).collect())
    assert rows == [(1, "response", None, 1, True), (2, "response", None, 1, True), (2, "revisit", 1, 1, True), (3, "response", None, 0, True)]


def test_base_counts_by_brute_force(spark, texts):
    labels = quality.quality_labels(spark, SF)
    got = {r.doc_id: r for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    import re

    for d, t in texts.items():
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if twice is not None:
            assert r.n_repeat_words == len({i + k for i, g in enumerate(grams) if g in twice for k in range(8)})
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_path_lengths_by_brute_force():
    rng = np.random.default_rng(1)
    good, box = rng.normal(0, 1, (60, 3)), rng.normal(0, 4, (80, 3))
    forest = quality.Forest(good, np.vstack([good, box]), trees=5, rows=32)
    x = rng.normal(0, 5, (40, 3))
    total = np.zeros(len(x))
    for feature, cut, left, right, depth in forest.trees:
        for i, row in enumerate(np.clip(x, forest.low, forest.high)):
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= cut[at] else right[at]
            total[i] += depth[at]
    assert np.allclose(forest.score(x), 2.0 ** (-total / 5 / forest.limit))


def test_language_scores_by_brute_force():
    texts = ["alpha beta gamma", "rot grün blau", "x", "", "alpha rot " * 50]
    at, share = zip(*[brute_subwords(t) for t in texts[:2] * 8])
    model = langid.Model(list(at), list(share), ["a", "b"] * 8, epochs=3)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    p = model.predict(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for i, t in enumerate(texts):
        places, weights = brute_subwords(t)
        z = (model.table[places] * np.asarray(weights)[:, None]).sum(0) / model.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(p[i], want, atol=1e-4)


def test_noisy_or_by_brute_force():
    import re

    rng = np.random.default_rng(3)
    model = object.__new__(toxicity.Model)
    model.weights, model.bias, model.slope, model.shift = rng.exponential(0.3, toxicity.BUCKETS), -3.0, 0.8, 0.2
    full = (1 << 64) - 1

    def mixed(letters, salt):
        h = sum(b * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(letters)) & full
        h = ((h ^ salt) * 0x9E3779B97F4A7C15) & full
        return (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & full) >> 46

    texts = ["you are awful. a nice day, isn't it? yes", "", "...", "one", "böse wörter hier!\ngute wörter dort", "x. y. z " * 40]
    got, place, worst = model.score(texts)
    for i, t in enumerate(texts):
        found = []
        for m in re.finditer(rb"[^.!?\n]+", t.encode()):
            words = [(w.start(), w.group()) for w in re.finditer(rb"[a-z\x80-\xff']+", m.group())]
            if words:
                hits = [mixed(w, 0) for _, w in words]
                hits += [mixed(w[:n], n) if len(w) >= n else mixed(w, 0) for _, w in words for n in toxicity.PREFIXES]
                z = sum(model.weights[h] for h in hits) + model.bias
                found.append((1 / (1 + np.exp(-np.clip(z, -30, 12))), m.start() + words[0][0]))
        either = 1 - np.prod([1 - p for p, _ in found]) if found else 0.0
        x = np.clip(np.log(max(either, 1e-12)) - np.log(max(1 - either, 1e-300)), -25, 25)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(0.8 * x + 0.2))), rel=1e-6)
        best = max(found, key=lambda f: (f[0], -f[1]), default=(0.0, -1))
        assert (worst[i], place[i]) == (pytest.approx(best[0]), best[1])


def test_documents_teach_their_sentences():
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(["sun", "tree", "river", "stone", "house"]) for _ in range(6))
    texts = [". ".join([clean(), "vile slur" if i % 2 else clean(), clean()]) for i in range(120)]
    parts = [(f, sentence, len(owner)) for f, sentence, owner, _ in map(toxicity.sentence_words, [[t] for t in texts])]
    model = toxicity.Model(parts, np.arange(120) % 2)
    score, place, worst = model.score(texts)
    assert (score[1::2] > 0.7).all() and (score[::2] < 0.3).all()
    assert [texts[i][at:].startswith("vile") for i, at in enumerate(place)] == [bool(i % 2) for i in range(120)]


def brute_subwords(text):
    """Buckets of all runs of three and four bytes, blanks for anything but letters, and their shares."""
    data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    hits = []
    for width in langid.WIDTHS:
        for i in range(len(data) - width + 1):
            h = 0
            for b in data[i : i + width]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            hits.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
    places = sorted(set(hits))
    return np.array(places, np.int64), np.array([hits.count(p) / len(hits) for p in places], np.float32)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    langs = queries.op7_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.99
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = queries.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out")
    rate = {(r.toxic, r.predicted): r["count"] for r in toxic.groupBy("toxic", "predicted").count().collect()}
    assert rate.get((0, 1), 0) < 0.01 * rate[0, 0] and rate[1, 1] > 0.6 * (rate[1, 1] + rate.get((1, 0), 0))
    good = {(r.quality, r.kept): r["count"] for r in queries.op10_quality(spark, sf).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert good.get((1, False), 0) <= 0.005 * good[1, True] and good[0, False] > 0.9 * (good[0, False] + good.get((0, True), 0))


def backoff_by_brute_force(texts):
    from collections import Counter

    cut = {d: (t or "").lower().encode().split() for d, t in texts.items()}
    one, two = Counter(w for c in cut.values() for w in c), Counter(p for c in cut.values() for p in zip(c, c[1:]))
    total = sum(one.values())
    out = {}
    for d, c in cut.items():
        value = sum(np.log(two[a, b] / one[a]) if two.get((a, b), 0) >= 2 else np.log(0.4 * one[b] / total) for a, b in zip([None, *c], c))
        out[d] = (len(c), len(c) - sum(two[p] >= 2 for p in zip(c, c[1:])), value / len(c) if c else None)
    return out


@pytest.mark.parametrize("block_bytes, part_words", [(1, 1 << 20), (50_000, 3000), (16 << 20, 1 << 20)])
def test_lm_scores_by_brute_force(spark, texts, block_bytes, part_words):
    # Words whose letters follow the Thue-Morse sequence, which polynomials modulo 2^64 confuse.
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    pair = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    texts = {**texts, 10**6: " ".join(pair), 10**6 + 1: f"{pair[0]} {pair[0]} x", 10**6 + 2: "", 10**6 + 3: None, 10**6 + 4: "one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, block_bytes=block_bytes, part_words=part_words).collect()}
    want = backoff_by_brute_force(texts)
    assert got.keys() == want.keys()
    for d, (n, backoff, score) in want.items():
        assert (got[d].n_words, got[d].n_backoff) == (n, backoff)
        assert (got[d].score is None) if score is None else abs(got[d].score - score) < 1e-5


def test_planes_give_numbers_back():
    rng = np.random.default_rng(4)
    for kind in (np.uint32, np.uint64, np.int64):
        x = rng.integers(0, np.iinfo(kind).max, 300, dtype=kind)
        assert lm_score.from_planes(lm_score.planes(x), kind).tolist() == x.tolist()
        assert len(lm_score.from_planes(lm_score.planes(x[:0]), kind)) == 0


def test_copies_with_short_lines_leave_no_husk(spark):
    rng = random.Random(3)
    long = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    docs, planted = [], set()
    for d in range(20):
        lines = [f"Title {d % 3}", long(), "read more", "read more", "", long(), f"by {d}"]
        docs.append((d, "\n".join(lines)))
        near = [x if i not in (1, 5) else " ".join(["new", *x.split()[1:]]) for i, x in enumerate(lines)]
        for k, copy in ((100, lines), (200, near), (300, lines[:2]), (400, near[5:])):
            docs.append((d + k, "\n".join(copy)))
            planted.add(d + k)
    rows = [(d, t, None, None, len(t)) for d, t in docs]
    out = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert out == {d: t for d, t in docs if d not in planted}


@pytest.mark.parametrize("small", [2, 32])
def test_copies_of_given_similarity_are_found(spark, small):
    rng = random.Random(8)
    docs, pairs = {}, {}
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 300]))]
        for share in (0.8, 0.85, 0.9, 0.7):
            base, copy = [f"s{share}k{k}", *words], [f"s{share}k{k}", *words]
            of = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            near = lambda c: len(of(base) & of(c)) / len(of(base) | of(c))
            # New words from the end on, as long as the similarity allows.
            while near(copy + ["end"]) >= share:
                copy.append(f"n{rng.randrange(10**6)}")
            base = [f"{w}x{share}" for w in base]
            copy = [f"{w}x{share}" for w in copy]
            docs[len(docs)] = " ".join(base)
            pairs[len(docs)] = share if near(copy) >= share else None
            docs[len(docs)] = " ".join(copy)
    long = " ".join(f"l{i}" for i in range(5000))
    docs[4000], docs[4001] = long, long + " end"
    # A large group, each one word away from the first.
    many = [f"m{i}" for i in range(200)]
    for i in range(80):
        docs[5000 + i] = " ".join([*many[:i], "z" * (i > 0), *many[i + 1 :]])
    rows = spark.createDataFrame([(*r, None) for r in docs.items()] + [(None, docs[0], None), (0, "its id is repeated but the text is another", None)], "doc_id long, text string, lang string")
    out = {(r.doc_id, r.text) for r in copies.keep_first(rows, small=small).collect()}
    for share in (0.8, 0.85, 0.9):
        later = [d for d, s in pairs.items() if s == share]
        assert len(later) > 100 and sum((d, docs[d]) in out for d in later) <= 1
    assert all((d, docs[d]) in out for d, s in pairs.items() if s == 0.7)
    assert sorted(d for d, _ in out if d is not None and d >= 4000) == [4000, 5000]
    assert (None, docs[0]) not in out and {(0, docs[0]), (0, "its id is repeated but the text is another")} <= out


def test_large_buckets_of_unlike_texts_take_few_rounds(spark, monkeypatch):
    rng = random.Random(12)
    # All texts fall into one bucket of each band; of ten there are near copies.
    monkeypatch.setattr(copies, "signature", lambda found: np.full(16, 7, np.uint64))
    written = []
    monkeypatch.setattr(copies, "pin", lambda df, label: written.append(label) or scratch.pin(df, label))
    docs = {i: [f"w{rng.randrange(10**6)}" for _ in range(40)] for i in range(150)}
    docs |= {1000 + 10 * i + k: [*docs[i][:-1], f"end{k}"] for i in range(10) for k in range(3)}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.keep_first(rows, small=2).collect()) == list(range(150))
    # 4, 64 and 1,024 texts are drawn.
    assert written.count("verified") <= 3


def test_bins_lose_no_pair_that_has_the_share(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for k in range(400):
        n = int(rng.choice([1, 5, 40, 300, 2000]))
        both = int(n * rng.choice([0, 0.5, 0.8, 0.9, 1]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.r_[a[:both], rng.integers(0, 1 << 63, len(a) - both, dtype=np.uint64) * np.uint64(2)])
        rows.append((k, len(a), copies.touched(a).view(np.int64).tolist(), len(b), copies.touched(b).view(np.int64).tolist()))
        want.append((both / (len(a) + len(b) - both), len(a)))
    df = spark.createDataFrame(rows, "k long, na long, sa array<long>, nb long, sb array<long>")
    got = {r.k for r in df.where(copies._may_share(800_000)).collect()}
    assert all(k in got for k, (share, _) in enumerate(want) if share >= 0.8)
    assert not any(k in got for k, (share, n) in enumerate(want) if share == 0 and 30 < n < 1000)


def test_pipeline_keeps_clean_documents(spark, texts):
    out = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert out and out <= set(texts)
    leaked = {r.doc_id for r in queries.op1_decontaminate(spark, SF).collect()}
    assert not out & leaked
    groups = queries.op3_simhash(spark, SF).where("doc_id <> component_id").count()
    assert len(out) >= len(texts) - len(leaked) - groups - queries.op10_quality(spark, SF).where("NOT kept").count() - 20


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_send_small_batches_to_python(spark):
    """Batches of 10,000 texts stayed in executors from stage to stage; a size that the session names itself holds."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.range(0, 2_000, 1, 1)
    sent = lambda: [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    spark.conf.unset(setting)
    assert max(sent()) == 2_000
    stages = dict(corpus_pipeline.STAGES)
    try:
        kept = {}
        for name in ("quality_rules", "simhash", "bpe"):
            spark.conf.set(setting, 10_000)
            whole = sorted(map(str, stages[name](spark, docs, SF).collect()))
            assert max(sent()) == 2_000, name
            spark.conf.unset(setting)
            small = sorted(map(str, stages[name](spark, docs, SF).collect()))
            assert max(sent()) <= 500 and sum(sent()) == 2_000, name
            kept[name] = whole, small
        assert all(whole and whole == small for whole, small in kept.values())
    finally:
        spark.conf.unset(setting)
    corpus_pipeline.run(spark, SF)
    assert setting not in spark.conf.getAll


def test_lm_block_counts_in_bounded_memory():
    """A block is counted within a few arrays of its size; sorting with all places took 61 bytes a word."""
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    codes = np.r_[np.arange(len(vocabulary)), rng.integers(0, len(vocabulary), 1_980_000)].astype(np.uint32)
    block = lm_score.Block(vocabulary, codes, np.array([0, 1, 300_000, 300_000, len(codes)]))
    words = vocabulary[codes]
    together = lm_score.pair_hashes(words[:-1], words[1:])
    together = np.delete(together, [0, 299_999])
    tracemalloc.start()
    found = [block.counted(kind) for kind in (0, 1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for kind, want in enumerate((words, together)):
        keys, at, n = np.unique(want, return_inverse=True, return_counts=True)
        assert found[kind][0].tolist() == keys.tolist() and found[kind][1].tolist() == n.tolist()
        size, places = block.places(kind)
        assert size == len(keys) and places.tolist() == at.tolist()
    assert peak < 45 * len(codes), peak / len(codes)


def test_bpe_caches_keep_to_their_size():
    """A smaller cache holds no more than a block beyond its size, and changes no result."""
    rng = random.Random(9)
    blocks = [["".join(rng.choices("abcdé", k=rng.randint(1, 6))) + " " + "x" * i for i in range(40)] for _ in range(6)]
    small, usual = bpe.TrieEncoder(WORD_BPE, cached=50), bpe.TrieEncoder(WORD_BPE)
    for block in blocks:
        assert list(small.tell(block)) == list(usual.tell(block)) and small.encode(block) == usual.encode(block)
        assert max(map(len, (small.told, small.pieces, small.words))) <= 50 + 80
    assert len(usual.told) > 150
