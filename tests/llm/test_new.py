"""Resampling, licence spans and periodic runs against brute force, planted cases and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import license_scan, periodic, quality, queries, resample

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, rank long, key long, score double, words string, start long"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, one long word, and columns with clashing names."""
    long = " ".join(f"w{i % 701}x" for i in range(20_000))
    texts = ["", None, long, long, "All Rights Reserved", "All Rights Reserved", " \n\t ", "y" * 300_000 + " é" * 30, "q " * 40]
    ids = [1, 2, None, 4, 5, 5, 6, 7, None]
    return spark.createDataFrame([(i, t, None, 3, None, 0.5, "v", 9) for i, t in zip(ids, texts)], SCHEMA)


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


# ---------------------------------------------------------------- resampling


def test_joined_crc():
    rng = random.Random(1)
    some = [rng.randbytes(rng.choice([0, 1, 2, 7, 300, 5000])) for _ in range(200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    other = some[::-1]
    got = resample.joined_crc(crc(some), crc(other), np.array([len(x) for x in other]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(some, other)]


def brute_ranks(docs, items, n, buckets, seed, min_words, draw):
    def runs(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in runs(x)), Counter(b for x in items for b in runs(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out, may = {}, []
    for doc_id, text in docs:
        found = runs(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        out[doc_id] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(words_of(text)) >= min_words:
            may.append(doc_id)
    may.sort(key=lambda d: (-out[d][2], d))
    for rank, d in enumerate(may[: len(may) * draw[0] // draw[1]]):
        out[d][3] = rank + 1
    return out


@pytest.mark.parametrize("n, block, draw", [(1, 4 << 20, (10, 100)), (3, 1 << 10, (37, 100)), (2, 1 << 12, (1, 1))])
def test_resampling_by_brute_force(spark, texts, monkeypatch, n, block, draw):
    monkeypatch.setattr(resample, "BLOCK_BYTES", block)
    texts = texts | {10**6: "y" * 500 + " zz " + "é" * 90 + " zz" * 30}
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    ranks = resample.resample_ranks(docs, target, max_words=n, buckets=997, draw=draw)
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in ranks.collect()}
    assert got == brute_ranks(list(texts.items()), items, n, 997, 2024, 20, draw)
    drawn = {r.doc_id: r.text for r in resample.drawn_documents(docs, ranks).collect()}
    assert drawn == {d: texts[d] for d, v in got.items() if v[3]}


def test_resampling_of_odd_tables(spark, odd):
    items = spark.createDataFrame([(0, "w1x w2x"), (None, None)], "item_id long, text string")
    rows = resample.resample_ranks(odd, items, draw=(1, 1)).collect()
    assert len(rows) == 9
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4]
    assert {r.n_features for r in rows if r.doc_id in (1, 2, 6)} == {0}
    for docs, target in ((odd.limit(0), items), (odd, items.limit(0)), (odd.limit(0), items.limit(0))):
        assert resample.resample_ranks(docs, target).count() == docs.count()


# ---------------------------------------------------------------- licences


def brute_statistics(runs, words):
    """At each word the longest run ending there that some template holds."""
    out = []
    for i in range(len(words)):
        n = 0
        while n <= i and tuple(words[i - n : i + 1]) in runs:
            n += 1
        out.append(n)
    return out


def test_matching_statistics_by_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        templates = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for k in range(4)]
        automaton = license_scan.LicenceAutomaton(templates, [("p", "a b"), ("q", "c")])
        cut = [t.split() for _, t in templates] + [["a", "b"], ["c"]]
        runs = {tuple(t[i:j]) for t in cut for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        words = [rng.choice("abcd") for _ in range(200)]
        found = list(automaton.statistics(w.encode() for w in words))
        assert [n for _, n in found] == brute_statistics(runs, words)
        for at, (state, n) in enumerate(found):
            if n:
                run = words[at - n + 1 : at + 1]
                ends = {k: [e for e in range(n - 1, len(t)) if t[e - n + 1 : e + 1] == run] for k, t in enumerate(cut[:4])}
                assert automaton.ends_in(state) == {k: e for k, e in ends.items() if e}


def test_licence_report_by_brute_force(spark, texts):
    notice = license_scan.TEMPLATES[1][1]
    planted = {10**6: f"x {notice}. y", 10**6 + 1: "intro " + " ".join(w for i, w in enumerate(notice.split()) if i % 12 != 11) + " Z", 10**6 + 2: "CC-BY cc by, General PUBLIC\nLicense!"}
    docs = texts | planted
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.label_report(license_scan.license_spans(rows)).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        w = words_of(text)
        places = [(i, label) for label, phrase in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        labels = sorted({label for _, label in places})
        # A template that stands whole is always found.
        whole = {label for label, t in license_scan.TEMPLATES for i in range(len(w)) if w[i : i + len(words_of(t))] == words_of(t)}
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(labels) and whole | set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert not (places or whole) or r.score == 1
    assert "apache-2.0" in got[10**6].labels and "apache-2.0" in got[10**6 + 1].labels
    assert got[10**6 + 2].labels == "cc-by,gpl"
    clean = [d for d, t in texts.items() if not re.search("licen|reserved", t or "", re.I)]
    assert len(clean) > 100 and all(not got[d].labels for d in clean)


def test_spans_and_odd_tables(spark, odd, monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE_BYTES", 16)
    (row,) = license_scan.license_spans(spark.createDataFrame([(1, "a b Released under the MIT License. c")], "doc_id long, text string")).collect()
    assert [tuple(s) for s in row.spans] == [("mit", 2, 6, 1.0)]
    rows = license_scan.label_report(license_scan.license_spans(odd)).collect()
    assert len(rows) == 9 and [(r.labels, r.score) for r in rows if r.doc_id == 5] == [("reserved", 1.0)] * 2
    assert {(r.n_words, r.labels, r.score) for r in rows if r.doc_id in (1, 2, 6)} == {(0, "", 0.0)}
    assert license_scan.license_spans(odd.limit(0)).count() == 0
    assert license_scan.license_spans(odd, templates=[], phrases=[]).count() == 9


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=24, times=3):
    out, seen = [], set()
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(kept))


def report(df, prepare=periodic.with_planted_tail, **given):
    found = periodic.run_report(periodic.collapsed(*periodic.periodic_runs(df, prepare, **given))).collect()
    return [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in found]


def test_runs_of_tables_by_brute_force(spark, texts):
    short = {d: t for d, t in texts.items() if len(t or "") < 8000}
    got = dict(report(spark.createDataFrame(list(short.items()), "doc_id long, text string")))
    assert got == {d: brute_report(d, t) for d, t in short.items()}
    assert sum(r[0] > 0 for r in got.values()) > 5


@pytest.mark.parametrize("tile_words", [1, 16, 64, 1 << 14])
def test_runs_across_tiles_by_brute_force(spark, tile_words):
    rng = random.Random(tile_words)
    docs = {}
    for d in range(120):
        words = [rng.choice("ab") if d % 3 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            root = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 16, 31, 40]))]
            many = root * rng.randrange(3, 12)
            at = rng.randrange(len(words) + 1)
            words[at:at] = many[: rng.randrange(2 * len(root), len(many) + 1)]
        docs[d] = " ".join(words)
    docs[500], docs[501], docs[502] = "a " * 700, "a b " * 350, "a a b " * 9 + "a a b a " * 12
    # One run within another: each period holds three of a short one.
    docs[503] = " ".join(([*"xy"] * 15 + [f"v{i}" for i in range(7)]) * 5)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = dict(report(table, None, tile_words=tile_words))
    for d, t in docs.items():
        runs = brute_runs(t.split())
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
        assert (got[d][0], got[d][5]) == (len(runs), hashlib.sha256(lines).hexdigest()), (d, runs)


@pytest.mark.parametrize("least, times", [(6, 3), (40, 4), (1, 3)])
def test_other_bounds(spark, least, times):
    rng = random.Random(least)
    docs = [(d, " ".join(rng.choice("aab") for _ in range(150))) for d in range(60)]
    _, runs = periodic.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string"), None, least, times)
    assert runs.count() == sum(len(brute_runs(t.split(), least, times)) for _, t in docs)
    with pytest.raises(ValueError):
        periodic.gram_size(24, 2)


def test_runs_of_odd_tables(spark, odd):
    rows = report(odd, None)
    assert len(rows) == 9
    found = sorted((r[1][:5] for r in rows), key=str)
    assert found.count((0, None, None, None, None)) == 5
    assert found.count((1, 0, 20_000, 701, 28530)) == 2 and (1, 0, 40, 1, 40_000) in found and (1, 1, 30, 1, 30_000) in found
    empty = hashlib.sha256(b"").hexdigest()
    assert {r[1][5:] for r in rows if r[0] in (1, 2, 6)} == {(empty, empty)}
    assert report(odd.limit(0)) == []


def test_queries_cover_whole_tables(spark):
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    for name in ("op11_licenses", "op12_resample", "op13_periodic"):
        assert queries.QUERIES[name](spark, SF).count() == n


@pytest.mark.parametrize("held", [25_600, 1000])
def test_quality_is_fitted_on_all_labelled_rows(spark, monkeypatch, held):
    """Box, draws and cut are those of all rows, also of the one that hashes highest, and both ways in judge alike."""
    rng = np.random.default_rng(4)
    n = 6500
    label = (rng.random(n) < 0.8).astype(int).tolist()
    words = lambda i: " ".join(f"w{rng.integers(10**6)}" + ("#|!"[i % 3] * int(rng.integers(1, 9)) if not label[i] or rng.random() < 0.1 else "") for _ in range(25))
    texts = [words(i) for i in range(n)]
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id")).collect()]
    last = ids[-1]
    label[last], texts[last] = 1, texts[last] + " " + "MORE" * 90
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, label int")
    x = np.asarray([quality.statistics(texts[i])[1] for i in ids])
    good = np.asarray([label[i] for i in ids]) > 0
    monkeypatch.setattr(quality, "HELD_ROWS", held)
    want = quality.Forest(x[good], x, drawn=quality.Forest.draws(int(good.sum())) if good.sum() > held else None)
    score = want.score(x)
    cut = np.sort(score[good])[::-1][int(0.01 * good.sum())]
    cut = (cut + score[~good & (score > cut)].min()) / 2

    forest, found = quality.fit(quality.pin(quality.described(docs), "test"), labels, max_false=0.01)
    assert (forest.low == x.min(0)).all() and (forest.high == x.max(0)).all()
    assert all((a == b).all() for one, two in zip(forest.trees, want.trees, strict=True) for a, b in zip(one, two))
    assert found == cut
    kept = {ids[i] for i in np.flatnonzero(score < cut)}
    assert {r.doc_id for r in quality.quality_rules(docs, labels, max_false=0.01).where("kept").collect()} == kept
    assert {r.doc_id for r in quality.keep_good(docs, labels, max_false=0.01).collect()} == kept
    assert {r.doc_id for r in quality.keep_good(docs, labels.limit(0)).collect()} == set(ids)
