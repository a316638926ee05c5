"""The chain model against plain forward-backward, held-out accuracy, switched text and odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sheaf.llm import language_crf as L

from tests.conftest import SF
from tests.llm.helpers import crc


def model(seed, n_labels):
    r = np.random.default_rng(seed)
    labels = [f"l{i}" for i in range(n_labels)]
    return L.Crf(labels, np.concatenate([r.normal(size=(L.HASHED, n_labels)), np.zeros((1, n_labels))]), {"ab": 1}, r.normal(size=(3 * n_labels + 1, n_labels)), 2 * r.normal(size=(n_labels, n_labels)))


def plain_posteriors(m, e):
    """Sums over all neighbours, one text at a time, in logarithms."""
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, len(e)):
        a[t] = e[t] + lse(a[t - 1][:, None] + m.transitions, 0)
    for t in range(len(e) - 2, -1, -1):
        b[t] = lse(m.transitions + (e[t + 1] + b[t + 1])[None, :], 1)
    p = a + b
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n_labels", [2, 5])
def test_posteriors_by_blocks_equal_plain_ones(n_labels):
    m, r = model(n_labels, n_labels), np.random.default_rng(1)
    sizes = np.array([1, 31, 32, 33, 64, 65, 500, 2, 96, 1000])
    e = 8 * r.normal(size=(sizes.sum(), n_labels))
    got, at = m.posteriors(e, sizes), 0
    for n in sizes:
        assert np.allclose(got[at : at + n], plain_posteriors(m, e[at : at + n]), atol=1e-9)
        at += n


def test_emissions_by_arrays_equal_single_words():
    m = model(3, 3)
    words = ["a", "ab", "längere", "漢字", "x" * 24, "ab"]
    assert np.allclose(m.emissions(words), np.concatenate([m.emissions([w]) for w in words]))


def two_languages(seed, n):
    r = random.Random(seed)
    a, b = ["the", "and", "thing", "with", "other", "sheath"], ["der", "und", "schein", "nicht", "über", "schacht"]
    return [(i, " ".join(r.choice((a, b)[i % 2]) for _ in range(r.randrange(5, 200))), ("en", "de")[i % 2]) for i in range(n)]


def test_learns_only_from_rows_that_are_not_held_out(spark):
    rows = two_languages(0, 120)
    held = lambda d: crc("" if d is None else d) % 3 == 1
    wrong = [(d, "unheard of" if held(d) else t, "xx" if held(d) else k) for d, t, k in rows]
    results = []
    for given in (rows, wrong):
        out = L.identify_languages(spark.createDataFrame(given, "doc_id long, text string, lang string")).collect()
        results.append({r.doc_id: (r.lang_pred, r.score) for r in out if not r.held_out})
        assert all(r.held_out == held(r.doc_id) and r.lang_pred in ("en", "de") for r in out)
    assert results[0] == results[1] and len(results[0]) > 50
    assert all(results[0][d][0] == k for d, _, k in rows if not held(d))


def test_switched_text_by_runs(spark):
    chunks = [(k, t.split()[:32]) for _, t, k in two_languages(1, 300)]
    english, german = "the other thing and the sheath with other thing " * 3, "der schein und nicht über schacht der und schein " * 3
    text = f"{english}{german}{english}"
    docs = spark.createDataFrame([(1, text), (2, english)], "doc_id long, text string")
    one, two = L.identify(docs, L.fit(chunks), spans=True).orderBy("doc_id").collect()
    assert [s.lang for s in one.spans] == ["en", "de", "en"] and one.lang_pred == "en" and one.n_switches == 2 and 0.6 < one.score < 0.75
    assert text[one.spans[1].begin : one.spans[1].end] == german.strip() and text[one.spans[2].begin : one.spans[2].end] == english.strip()
    assert [(s.begin, s.end) for s in two.spans] == [(0, len(english.strip()))] and two.score > 0.99


def test_odd_cases(spark):
    rows = [*two_languages(2, 60), (1000, None, "en"), (1001, "", "en"), (1002, "123 !? ²½", "de"), (1003, "the", None), (None, "the and thing", "en"), (None, "der und nicht", "de"), (1004, "the and " * 50_000, "en"), (1005, "und" * 9000, "de"), (1006, "कि हिन्दी 日本語 the", None)]
    given = spark.createDataFrame([(d, t, k, "a", 5) for d, t, k in rows], "doc_id long, text string, lang string, _text string, score int").repartition(3)
    out = L.identify_languages(given)
    assert out.columns == ["doc_id", "text", "lang", "_text", "lang_pred", "score", "n_words", "n_switches", "held_out"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert len(got) == len(rows) and {(r.lang_pred, r.score) for r in got.values() if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert got[1004, "the and " * 50_000].lang_pred == "en" and got[1004, "the and " * 50_000].n_words == 100_000
    assert got[None, "der und nicht"].held_out is False and got[1006, rows[-1][1]].n_words == 4
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got.values())
    none = L.identify_languages(given.where("lang is null")).collect()
    assert len(none) == 2 and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert {r.lang_pred for r in L.identify_languages(given.where("lang = 'en' or lang is null")).collect()} == {"en", "und"}
    assert L.identify_languages(given.limit(0)).collect() == []


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.identify_languages(docs).where("held_out and lang is not null")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 40 and right >= 0.97
