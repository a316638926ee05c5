"""Chunks as the index of repeated passages: what goes is every repeated window, and most of it goes as chunks."""

import random

import pytest
from pyspark.sql import functions as F
from sheaf.llm import line_dedup
from sheaf.llm.line_dedup import dedup_lines, units

from tests.llm.helpers import words


def brute(texts):
    """Repeated windows of two lines and long lines, by dictionaries; the exact texts that are left."""
    places = {}
    for d in sorted(texts):
        lines = texts[d].split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        for i, j in zip(full, full[1:]):
            places.setdefault(tuple(lines[i : j + 1]), []).append((d, i, j + 1))
        for i in full:
            if len(words(lines[i])) >= 50:
                places.setdefault((lines[i],), []).append((d, i, i + 1))
    gone = {}
    for found in places.values():
        first, end = found[0][0], found[0][2]
        for d, i, j in found[1:]:
            if d != first or i >= end:
                gone.setdefault(d, set()).update(range(i, j))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in texts.items()}


def left(spark, texts):
    return {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def some_texts(seed, kinds):
    """Texts of lines of few kinds, blank ones among them, so that windows repeat in every way."""
    rng = random.Random(seed)
    line = lambda: rng.choice(["", " ", *[f"line {i}" for i in range(kinds)]])
    shared = [[line() for _ in range(rng.randint(2, 9))] for _ in range(6)]
    texts = {}
    for d in range(80):
        parts = [rng.choice(shared) if rng.random() < 0.4 else [line() for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(0, 6))]
        texts[d] = "\n".join(x for p in parts for x in p)
    return texts


@pytest.mark.parametrize("seed,kinds", [(1, 2), (2, 6), (3, 40), (4, 400)])
def test_what_is_left_is_exactly_that_of_all_windows(spark, seed, kinds):
    texts = some_texts(seed, kinds)
    assert left(spark, texts) == brute(texts)


def passages(n=30):
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8))
    passage = [line() for _ in range(40)]
    return {d: "\n".join([line() for _ in range(rng.randint(1, 5))] + passage + [line() for _ in range(rng.randint(1, 5))]) for d in range(n)}


def test_without_chunks_removals_are_lost(spark, monkeypatch):
    texts = passages()
    want = brute(texts)
    assert left(spark, texts) == want
    monkeypatch.setattr(line_dedup, "units", lambda *a: F.filter(units(*a), lambda u: ~u["chunk"]))
    lost = {d: t for d, t in left(spark, texts).items() if t != want[d]}
    assert len(lost) == len(texts) - 1  # in every copy but the first
    assert all(len(t.split("\n")) > len(want[d].split("\n")) + 10 for d, t in lost.items())


def test_windows_inside_a_chunk_count_once_for_all_its_places(spark):
    texts = passages()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = df.select("doc_id", F.inline(units(F.col("text"), F.xxhash64("doc_id")))).collect()
    codes, places = {}, {}
    for r in rows:
        codes.setdefault(r.h, set()).add(r.code)
        places[r.h] = places.get(r.h, 0) + 1
    everywhere = [h for h, n in places.items() if n == len(texts)]
    alone = [h for h in everywhere if len(codes[h]) == 1]
    assert len(everywhere) > 40 and len(alone) > len(everywhere) // 3
