"""License scan, fill-in-the-middle and divergence audit: SQL, brute force, and odd rows; joins of repeated ids."""

import hashlib
import gzip
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_oracles import TABLES, rows
from tidepool.llm import divergence, fill_middle, language_model, licenses, ngram_join, packing, quality_classifier, toxicity, warc

from .test_llm import odd  # noqa: F401


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_source_divergence", "op10_ngram_join"])
def test_sql(name, spark, sf):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = __spark_entry__.queries()[name](spark, sf).toPandas(), duck.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_join_keeps_links_of_repeated_ids(spark):
    """A doc_id with two texts has the links of both."""
    rng = random.Random(3)
    a, b = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "ab")
    got = ngram_join.similar(spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (9, b + " q"), (1, b), (12, "far away from all")], "doc_id long, text string"), 3, 90)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (9, 1), (12, 12)]
    # two ids share a smallest id of their sets, and a set's smallest id belongs to another text as well
    got = ngram_join.similar(spark.createDataFrame([(5, a), (5, b), (7, b + " z"), (8, a), (None, b), (6, "")], "doc_id long, text string"), 3, 90)
    assert Counter((r.doc_id, r.component_id) for r in got.collect()) == Counter([(5, 5), (5, 5), (7, 5), (8, 5), (None, None), (6, 6)])


def brute_cut(doc_id, text, unit=fill_middle.LINES):
    units = re.findall(unit, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in fill_middle.SENTINELS) or "".join(units) != text:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [
    "", None, "one line", "\n\n\n", "a\nb\nc", "a\r\nb\rc\n", "née \U0001f600\n世界\n\nx", "has <S> in it\nand more\n", "<P\n>S>\n<<M\nS>", "same\ntext\n", "same\ntext\n", "   x \x0b\n y",
    "\n".join(f"line {i} é" for i in range(20_000)), "z" * 300_000,
]


def test_fill_middle_against_brute_force(spark):
    data = [(k * 10 + j, t) for j in range(6) for k, t in enumerate(TEXTS)] + [(None, "no\nid\n"), (3, "another\ntext\nof three\n"), (3, "another\ntext\nof three\n")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_middle.rewritten(df).collect())
    assert got == Counter((i, *brute_cut(i, t or "")) for i, t in data)
    hashed = {(r.doc_id, r.restored_sha256) for r in fill_middle.digests(df).collect()}
    assert hashed == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data}
    words = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_middle.rewritten(df.filter("doc_id < 12"), unit=r"\s*\w+").collect())
    assert words == Counter((i, *brute_cut(i, t or "", r"\s*\w+")) for i, t in data if i is not None and i < 12)


def test_fill_middle_settings(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb\nc\n") for i in range(200)], "doc_id long, text string")
    assert {r.form for r in fill_middle.rewritten(df, fim_percent=0).collect()} == {"plain"}
    some = Counter(r.form for r in fill_middle.rewritten(df, fim_percent=50, spm_percent=0).collect())
    assert 60 < some["plain"] < 140 and not some["spm"]
    own = ("[PRE]", "[SUF]", "[MID]")
    assert {(r.doc_id, r.restored_sha256) for r in fill_middle.digests(df, sentinels=own).collect()} == {(i, hashlib.sha256(f"a{i}\nb\nc\n".encode()).hexdigest()) for i in range(200)}


def brute_audit(data, min_docs=10):
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in data:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        found[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = sorted(w for w, c in docs[lang].items() if c >= min_docs)
        groups = {s: c for (own, s), c in found.items() if own == lang}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if groups[s][w] and p[s][w] > q[w])[:10]
            out += [(lang, s, part, i.decode(), -v, n + 1) for part, rows_ in (("pair", pairs), ("term", terms)) for n, (v, i) in enumerate(rows_)]
    return Counter(out)


def audited(df, **options):
    return Counter(tuple(r) for r in divergence.audit(df, **options).collect())


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(300)]
    data = [(" ".join(rng.choice(words[k % 7 :: 1 + k % 3]) for _ in range(rng.randrange(60))).title(), ["en", "fr", None][k % 3], f"s{k % 11 if k % 4 else 0}") for k in range(500)]
    data += [("seldom", "xx", "a"), ("seen", "xx", "b"), (None, "en", "empty"), ("", "yy", None), ("A1b2_C", "en", None)]
    df = spark.createDataFrame(data, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS block", "'x' AS number", "3 AS cut")
    want = brute_audit(data)
    assert audited(df) == want
    # many cells, and more blocks than groups
    assert audited(df.repartition(7), slice_terms=16, blocks=4) == want and audited(df, cell=64, blocks=16) == want
    assert audited(df, min_docs=10**6) == brute_audit(data, 10**6)
    assert not divergence.audit(df.limit(0)).count()


def test_every_pair_of_blocks_meets_once(spark):
    for n in (2, 4, 8, 10):
        turns = [spark.range(n).selectExpr("cast(id AS int) AS block").select("block", divergence.opponent(F.col("block"), t, n).alias("o")).collect() for t in range(n - 1)]
        met = Counter(frozenset((r.block, r.o)) for t in turns for r in t if r.o < r.block)
        assert len(met) == n * (n - 1) // 2 and set(met.values()) == {1} and all(len({r.o for r in t}) == n for t in turns)


def test_shares_of_large_counts():
    for c, n, v in [(0, 0, 1), (10**14, 3 * 10**14, 10**7), (5, 7, 3), (10**9, 10**9, 1)]:
        assert divergence.shares(np.array([c]), np.array([n]), np.array([v]))[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


def brute_bases(text):
    words, places, labels = licenses.words_of(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    mit, gpl = licenses.NOTICES["mit"][0], licenses.NOTICES["gpl-3"][0]
    changed = mit.replace("free of charge", "at no charge whatsoever").replace("publish, ", "").replace("Software", "software")
    filler = " ".join(f"filler{i}" for i in range(50))
    texts = [
        "", None, "under the mit", "Licensed UNDER the\n-MIT- license, and again under the MIT License.", f"{filler} {changed} {filler}", f"{gpl[:60]} {filler}", "Apache License, Version 2.0 cc-by-nc", "cc by nc" * 3, "ccby nc",
        "licensed under CC BY-SA 4.0", "Licensed under CC BY-NC 4.0", f"{filler} {gpl} {gpl} {filler}", "née under the mit licenseé", " ".join(["under the mit license"] * 3000), " ".join(mit.split()[::-1]), "released under the license of mit",
    ]
    data = [*enumerate(texts), (3, texts[3]), (3, "cc by nc"), (None, "cc by nc x")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS template", "2 AS hash", "'x' AS label")
    got = licenses.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *brute_bases(t or "")) for i, t in data)
    labels = {r.doc_id: (r.labels, r.score) for r in got if r.doc_id != 3}
    assert labels[4][0] == "mit" and 0.8 <= labels[4][1] < 1 and labels[5] == ("", 0.0) and labels[9] == ("cc-by-sa", 1.0) and labels[10] == ("cc-by-nc", 1.0)
    assert labels[11] == ("gpl-3", 1.0) and labels[14] == ("", 0.0) and labels[15] == ("", 0.0) and labels[0] == labels[1] == ("", 0.0) and labels[None] == ("cc-by-nc", 1.0)
    spans = next(r.spans for r in got if r.doc_id == 11)
    assert [(s.first, s.last) for s in spans if s.label == "gpl-3"] == [(50, 49 + len(licenses.words_of(gpl))), (50 + len(licenses.words_of(gpl)), 49 + 2 * len(licenses.words_of(gpl)))]
    assert not licenses.scan(df.limit(0)).count()


def test_licenses_of_the_documents(spark, sf):
    got = {r.doc_id: r for r in __spark_entry__.queries()["op11_license_scan"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_bases(d.text or "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


@pytest.mark.parametrize("call", [lambda d: licenses.scan(d), lambda d: fill_middle.digests(d), lambda d: divergence.audit(d)])
def test_odd_rows(odd, call):  # noqa: F811
    got = call(odd)
    if "doc_id" in got.columns:
        rows_ = got.collect()
        assert len(rows_) == 11 and sum(r.doc_id is None for r in rows_) == 1 and sum(r.doc_id == 4 for r in rows_) == 2
    else:
        assert {(r.lang, r.source, r.item) for r in got.filter("part = 'pair'").collect()} == {(lang, *pair) for lang in ("", "en") for pair in (("s", ""), ("", "s"))}
    assert call(odd.limit(0)).count() == 0


def test_archives_of_both_kinds(spark, tmp_path):
    """Compressed and plain files, through windows that are smaller than records, and a file that ends too early."""
    pages = [(i, f"u{i}", "x" * (i * 700) + "é") for i in range(20)] + [(50, None, None)]
    whole = {i: b"".join(d for *_, d in warc.record_chunks(i, u, (t or "").encode(), None)) for i, u, t in pages}
    raw = b"".join(whole.values())
    plain = b"".join(gzip.decompress(x) for x in whole.values())
    want = [(str(i), len((t or "").encode())) for i, _, t in pages]
    for data in (raw, plain):
        for window in (100, 1 << 20):
            assert [p.result()[:2] for p in warc._records(memoryview(data), window)] == want
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(plain)
    (tmp_path / "c.warc").write_bytes(b"")
    assert Counter((str(r.page_id), r.payload_bytes) for r in warc.read_files(spark, str(tmp_path)).collect()) == Counter(want * 2)
    for cut in (raw[:-9], plain[:-60]):
        with pytest.raises(ValueError):
            [p.result() for p in warc._records(memoryview(cut), 100)]


@pytest.mark.parametrize("parts", [5, 12])
def test_language_model_in_parts(spark, parts):
    """Chunks and parts on a corpus of a few kilobytes: counts and base scores are those of one part, scores a token lie within 0.1 of them and in the mean within 0.02."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(words, rng.integers(5, 40), p=weights / weights.sum()))) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, "w0 w1"), (1000, None)], "doc_id long, text string")
    size = sum(len(t) + 1 for _, t in rows)
    one, many = ({r.doc_id: r for r in language_model.score(df, n).collect()} for n in (size * 2, size // parts))
    assert one.keys() == many.keys() and len(one) == 302
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (many[i].n_tokens, many[i].n_known, many[i].train_tokens, many[i].held_out) and abs(r.base_score - many[i].base_score) < 1e-9
    off = np.array([(many[i].score - r.score) / r.n_tokens for i, r in one.items()])
    assert abs(off).max() < 0.1 and abs(off.mean()) < 0.02


def test_classifiers_and_archives_of_no_or_odd_rows(spark, odd):  # noqa: F811
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    for module, empty in ((quality_classifier, labels), (toxicity, labels)):
        got = module.classify(odd, module.train(odd, empty)).collect()
        assert len(got) == 11 and all(0 <= r.score <= 1 for r in got) and module.classify(odd.limit(0), module.train(odd.limit(0), labels.limit(0))).count() == 0
    pages = odd.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "media", "row")
    assert len(warc.read_archives(warc.write_archives(pages)).collect()) == 11 and warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    from .test_llm import WORD_BPE

    pieces = packing.pack(odd, WORD_BPE).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd.collect()} and sum(r.length for r in pieces if r.doc_id in (1, 2)) == 2
    kept = odd
    for name, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, kept, "")
        assert kept.columns == odd.columns, name
    assert corpus_pipeline.STAGES[3][1](spark, odd.limit(0), "").count() == 0
