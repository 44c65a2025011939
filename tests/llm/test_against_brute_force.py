"""The queries over the smallest tables, row for row against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest

from quillspark.llm import packing, queries, secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def run(spark, name):
    return getattr(queries, name)(spark, SF).collect()


def test_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, "op1_html_wrappers")}
    assert got == {r.page_id: (r.url, t, len(t)) for r in pages for t in [brute.article(r.html)]}


def test_quality_verdicts(spark):
    """Most labelled bad texts go; labelled good ones go by the base rule alone."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op2_quality_rules(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels]
    bad, good = [[r for r in rows if labels[r.doc_id] == q] for q in (0, 1)]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(not r.kept and not r.base_failed for r in good) <= 0.01 * len(good)


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op2_quality_rules")}
    assert len(got) == len(docs)
    for d, t in docs:
        r = got[d]
        n = brute.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.kept and r.base_failed)


def test_shards_match_the_mixture(spark, docs):
    rows = run(spark, "op3_interleaved_shards")
    texts = dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by, mixture = {}, {}
    for r in rows:
        assert (r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 16, brute.crc(texts[r.doc_id]))
        assert r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
        mixture.setdefault(r.source, {}).setdefault(r.shard, 0)
        mixture[r.source][r.shard] += 1
    assert set(by) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for shards in mixture.values():
        n = [shards.get(s, 0) for s in range(40)]
        assert max(n) - min(n) <= 2


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    by, sequences = {}, {}
    for r in run(spark, "op4_best_fit_packing"):
        by.setdefault(r.doc_id, []).append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by.keys() == ids.keys()
    for d, rows in by.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) == len(ids[d])
        assert all(r.length == 2048 for r in rows[1:])
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= 2048
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_simhash(spark, docs):
    rows = run(spark, "op6_simhash_classes")
    prints = [(d, brute.fingerprint(t)) for d, t in docs]
    want = brute.components(prints)
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in rows} == want
    assert all(len(r.fingerprint) == 16 for r in rows)


def test_benchmark_overlap(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in run(spark, "op8_benchmark_overlap")}
    assert got == {d: brute.overlap(t, items) for d, t in docs}


def test_repeated_passages(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in run(spark, "op9_repeated_passages")}
    assert got == dict(zip((d for d, _ in docs), brute.repeats(docs)))


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op10_secret_spans")}
    assert len(got) == len(docs)
    for d, t in docs:
        base, r = brute.secrets(t), got[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
    added = {d: [x for x in r.spans.split(",") if x.startswith("random")] for d, r in got.items()}
    assert {d: x for d, x in added.items() if x} == brute.discoveries(docs, secrets)
