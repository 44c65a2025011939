"""Queries without SQL, row for row against plain Python: over the smallest tables, or over small fixtures of their own."""

from difflib import SequenceMatcher

import pytest

from quillspark.plans.catalog import QUERIES
from quillspark.plans.catalog import SQL
from tests import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_no_query_is_without_a_test():
    here = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(QUERIES) - set(SQL) <= here


def test_fuzzy_best_match(spark, tmp_path):
    texts = [
        "Passport PO\nANNA MARIA X1234567 UTO\nF 01/02/2020\nANNA MARIE X1234567",
        "x\nJosé Núñez AB12 utopia\nJose Nunes; AB 12 34, born 1/2/2020\nnone of it",
        "only one line",
        "a\n\nfemale f\n01 02 2020",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["fuzzy_best_match"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, {})[r.field_key] = (r.expected_value, r.text, r.score, r.match_type)
    assert got == {k: plain.best_matches(t) for k, t in enumerate(texts)}


def test_matching_blocks(spark, tmp_path):
    texts = ["same\nabc def", "same\nxyz abc", "other\nabc def"]
    spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.turn: r.ratio for r in QUERIES["matching_blocks"](spark, str(tmp_path)).collect()}
    assert rows == {k: round(SequenceMatcher(None, a, b).ratio(), 9) for k, (a, b) in enumerate(zip(texts, texts[1:]))}


def test_reading_order(spark, docs):
    got = {}
    for r in QUERIES["reading_order"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.nth] = (r.line, r.position)
        assert r.id == f"word_{r.position:04d}"
    assert got == {d: x for d, t in docs.items() if (x := plain.reading_order(t))}


def test_kept_faces(spark):
    pages, got = {}, {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        face = (r.l_linenumber, float(r.l_partkey % 500), float(r.l_partkey % 300), 20 + r.l_quantity, 24 + r.l_quantity, 0.6 + r.l_discount * 3)
        pages.setdefault(r.l_orderkey, []).append(face)
    for r in QUERIES["kept_faces"](spark, SF).collect():
        got.setdefault(r.doc_id, set()).add(r.order)
    assert got == {k: x for k, f in pages.items() if (x := plain.suppressed(f))}


def test_decoded_faces(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        e = [float(x) for x in r.embedding]
        for nth, f in enumerate([*plain.decoded(e[:32], 8, 1.5, 2.0), *plain.decoded(e[32:], 16, 1.5, 2.0)]):
            want.append((r.vec_id, nth, *f[:4], *f[4], f[5]))
    got = [(r.vec_id, r.nth, r.left, r.top, r.width, r.height, *r.landmarks, r.score) for r in QUERIES["decoded_faces"](spark, SF).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a == pytest.approx(b, abs=2e-4, rel=1e-5)


def test_label_payloads(spark, docs):
    got = {r.doc_id: (r.n, r.tags) for r in QUERIES["label_payloads"](spark, SF).collect()}
    assert got == {d: plain.tagged(t) for d, t in docs.items()}


def test_portraits(spark, docs):
    got = {r.doc_id: (r.left, r.top, r.score) for r in QUERIES["portraits"](spark, SF).collect()}
    assert got == {d: plain.portrait(d, t) for d, t in docs.items()}
