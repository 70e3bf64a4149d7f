"""Nulls, empty and very long texts, ties, repeated rows and clashing columns through every text operator."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from quirefold.llm import arrays, bpe, langid, packing, rlz_dedup, secrets, setsketch, suffix_dedup, suffix_tree_lm

LONG = "word " * 400_000
ROWS = [
    (1, LONG, "aa", "x", 1, None),
    (2, None, None, None, None, "t"),
    (3, "", "aa", "", 0, None),
    (4, "x" * 300_000, "bb", "x", 3, "t"),
    (5, "same text here", "bb", "x", 2, None),
    (5, "same text here", "bb", "x", 2, None),
    (6, "same text here", None, None, None, None),
    (None, "same text here", "aa", None, None, "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns named as results of the operators
    names = ["n_words", "spans", "score", "lang_pred", "rejected", "ids", "n_tokens", "decoded", "base", "piece", "component_id", "kept", "_block"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, tag string")
    return df.selectExpr("*", *[f"'old' as {n}" for n in names])


def test_dedups(docs):
    for f in (rlz_dedup.rlz_dedup, suffix_dedup.suffix_dedup):
        rows = f(docs).collect()
        assert len(rows) == len(ROWS)
        by = {r.doc_id: r for r in rows}
        assert by[1].n_words == 400_000 and by[2].text is None and by[2].n_words == 0 and by[3].text == ""
        cut = sum(s.end - s.start for s in by[1].spans)
        assert cut == (400_000 if f is rlz_dedup.rlz_dedup else 399_999)


def test_near_duplicates(docs):
    rows = setsketch.near_duplicates(docs, shingle=2).collect()
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False), (None, None, True)], key=str)


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert p == (o + n if s == t else 0)


def test_bpe(docs):
    rows = bpe.encode(docs).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.n_tokens for r in rows}[1] == 400_000
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_language(docs):
    rows = langid.identify(docs, langid.learn(docs)).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.lang_pred for r in rows}[2] == "und"


def test_secrets(docs):
    assert secrets.scan(docs).count() == len(ROWS) and secrets.redact(docs).count() == len(ROWS)


def test_scoring(docs):
    rows = suffix_tree_lm.fit_and_score(docs, F.lit(True), min_context=50, min_entry=5).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.n_tokens for r in rows}[1] == 400_001
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_parts_of_very_long_texts():
    v = np.random.default_rng(1).integers(0, 2**63, (1 << 24) + 1000, dtype=np.uint64)
    got = arrays.sliding_argmin(v, 28)
    assert len(got) == len(v) - 27
    for i in (0, (1 << 23) - 5, 1 << 23, 1 << 24, len(got) - 1):
        assert got[i] == i + v[i : i + 28].argmin()
