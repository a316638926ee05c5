"""Importance resampling against a plain version, and odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from sheaf.llm.importance_resampling import resample

from tests.llm.helpers import LOW

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    w = WORDS.findall((text or "").translate(LOW))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, percent=10, least=20):
    """(doc_id, text) rows to Counter of (doc_id, n_features, weight, score), and those drawn in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in features(x, n)[1]) for xs in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s_all + buckets) / ((s[k] + 1) * (t_all + buckets))))
    out, can = [], []
    for d, x in docs:
        w, f = features(x, n)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        row = (d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        out.append(row)
        if len(w) >= least:
            can.append(row)
    can.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    return Counter(out), can[: percent * len(can) // 100]


def rows(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Éa", "éA", "x-y", "漢字", "A1", "_", "\x7f"]
    docs = [(i, " ".join(r.choice(words[: r.choice((20, 307))]) for _ in range(r.randrange(60)))) for i in range(n)]
    return [*docs, (3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1] + " tail" * 30), (None, docs[5][1] + " tail" * 30), (7, None), (8, ""), (9, "a b " * 40_000), *[(1000 + i % 3, "same words " * 12) for i in range(60)]]


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_resample_against_plain(spark, ngrams):
    docs, target = rows(ngrams, 200), ["w1 w2 w3 w1 w2", "Éa w5 w6", None, "漢字"]
    given = spark.createDataFrame([(d, x, i, "s") for i, (d, x) in enumerate(docs)], "doc_id long, text string, rank int, _place string").repartition(5)
    got = resample(given, spark.createDataFrame([(x,) for x in target], "text string"), ngrams=ngrams, percent=30).collect()
    want, drawn = plain(docs, target, ngrams, percent=30)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in ranked] == drawn


def test_kept_columns_and_clashing_names(spark):
    given = spark.createDataFrame([(1, "a b c", 5, "x", "y"), (2, "d " * 30, 6, "x", "y")], "doc_id long, text string, weight int, _k0 string, _n_words string")
    out = resample(given, given.select("text"), keep=["_k0", "weight", "_n_words", "text"], percent=100)
    assert out.columns == ["_k0", "_n_words", "text", "n_features", "weight", "score", "rank"]
    assert sorted((r["_k0"], r["text"][:1], r["rank"]) for r in out.collect()) == [("x", "a", None), ("x", "d", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none.select("text")).collect() == []
    one = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    assert [r["rank"] for r in resample(one, none.select("text"), percent=100).collect()] == [1]
    assert [r["rank"] for r in resample(one, none.select("text")).collect()] == [None]
