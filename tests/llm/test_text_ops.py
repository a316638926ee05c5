"""Rules, line dedup, mixing, classifier, language model: brute force and odd cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sheaf.llm import lm_scoring as LM
from sheaf.llm.line_dedup import dedup_lines
from sheaf.llm.quality_classifier import classify, fit
from sheaf.llm.quality_rules import features, judge
from sheaf.llm.source_mixing import DEFAULT, Target, marginal_error, mix, rake

from tests.llm.helpers import crc, words

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h " * 40), (6, "é# <x> | $\r\nline\rline\n\nline\nline"), (None, "no id here"), (7, "tie text tie text"), (7, "tie text tie text"), (8, "x" * 5000 + " " + "word " * 3000)]


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def counts(text):
    w = words(text, lower=False)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    cover = {k for i, x in enumerate(windows) if often[x] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_rule_counts(spark):
    got = features(docs(spark, ODD)).collect()
    want = Counter((d, *counts(t)) for d, t in ODD)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_judge_empty_and_odd(spark):
    assert judge(docs(spark, []).where("false")).count() == 0
    out = judge(docs(spark, ODD).withColumn("votes", F.lit(1)).withColumn("kept", F.lit("x"))).collect()
    assert len(out) == len(ODD)
    assert all(not r.kept for r in out if r.base_failed)
    assert all(r.base_failed for r in out if r.doc_id in (1, 2, 3, 4))


def test_line_dedup_removes_repeats_keeps_first(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(8))
    shared = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(6)] + shared + [line() for _ in range(5)])) for i in range(1, 8)]
    clean = [(100 + i, "\n".join(line() for _ in range(9))) for i in range(5)]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows + clean)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_lines_removed == 0
    for i, text in rows[1:]:
        assert got[i].n_lines_removed >= 25  # borders inside the passage are the same everywhere
        left = got[i].text.split("\n")
        assert left[:4] == text.split("\n")[:4] and left[-3:] == text.split("\n")[-3:]
    assert all(got[i].text == t for i, t in clean)


def test_line_dedup_odd(spark):
    rows = [*ODD, (20, "p q\nr s\nt u\nv w"), (21, "p q\nr s\nt u\nv w"), (22, "p q\nr s\nt u\nv w\n")]
    out = dedup_lines(docs(spark, rows).withColumn("h", F.lit(1)).withColumn("n_lines_removed", F.lit("x")))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(rows)
    assert dict(got)[1] is None and dict(got)[20] == "p q\nr s\nt u\nv w" and dict(got)[21] == ""
    assert sorted(t for d, t in got if d == 7) == ["tie text tie text"] * 2
    assert dedup_lines(docs(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("blank", [False, True])
def test_line_dedup_finds_short_passages_between_unrelated_lines(spark, blank):
    rng = random.Random(11)
    line = lambda n=8: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        size = k % 6 + 1
        passage = [line(50)] if size == 1 else [line() for _ in range(size)]
        if blank and size > 1:
            passage.insert(1, "")
        for copy in range(2):
            before, after = [line() for _ in range(rng.randint(1, 4))], [line() for _ in range(rng.randint(1, 4))]
            rows.append((2 * k + copy, "\n".join(before + passage + after)))
            want[2 * k + copy] = (rows[-1][1], 0) if copy == 0 else ("\n".join(before + after), len(passage))
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == want


def test_line_dedup_of_rows_that_share_an_id(spark):
    lines = [f"line {i} of a passage" for i in range(20)]
    rows = [(1, "\n".join(["a b", *lines])), (1, "\n".join([*lines, "c d"])), (None, "\n".join(["e f", *lines, "g"])), (9, "\n".join(lines[:3])), (9, "\n".join(lines[:3]))]
    got = [(r.doc_id, r.text, r.n_lines_removed) for r in dedup_lines(docs(spark, rows)).collect()]
    whole = [x for x in got if lines[5] in x[1]]
    assert len(got) == 5 and len(whole) == 1 and whole[0][0] is None  # the one without an id comes first
    assert Counter((d, t) for d, t, _ in got if d is not None) == Counter([(1, "a b"), (1, "c d"), (9, ""), (9, "")])
    two = [(7, "p\nq r\ns t"), (7, "q r\ns t\nu")]
    left = sorted(t for _, t, _ in ((r.doc_id, r.text, 0) for r in dedup_lines(docs(spark, two)).collect()))
    assert left in (["p", "q r\ns t\nu"], ["p\nq r\ns t", "u"])


def test_line_dedup_against_brute_force(spark):
    """Windows of two lines and long lines, by dictionaries, over every document; chunks only add to what goes."""
    from tests.conftest import SF

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    places: dict[tuple, list] = {}
    for d in sorted(texts):
        lines = texts[d].split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        for i, j in zip(full, full[1:]):
            places.setdefault(tuple(lines[i : j + 1]), []).append((d, i, j + 1))
        for i in full:
            if len(words(lines[i])) >= 50:
                places.setdefault((lines[i],), []).append((d, i, i + 1))
    gone: dict[int, set] = {}
    for found in places.values():
        first, end = found[0][0], found[0][2]
        for d, i, j in found[1:]:
            if d != first or i >= end:
                gone.setdefault(d, set()).update(range(i, j))
    must = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in texts.items()}
    got = {r.doc_id: r.text or "" for r in dedup_lines(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()}
    differ = [d for d in texts if [x for x in got[d].split("\n") if words(x)] != [x for x in must[d].split("\n") if words(x)]]
    assert set(got) == set(texts) and not differ


def test_line_dedup_within_a_text(spark):
    rows = [(1, "\n".join(["r s"] * 5)), (2, "u v\nw x\ny z\nu v\nw x"), (3, "k l\nm n"), (4, "q\nk l\nm o"), (5, "x y " * 24 + "z"), (6, "x y " * 24 + "z"), (7, "v w " * 25), (8, "v w " * 25)]
    got = {r.doc_id: r.text for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[1] == "r s\nr s" and got[2] == "u v\nw x\ny z"  # the first place keeps both of its lines
    assert all(got[i] == t for i, t in rows if i in (3, 4, 5, 6, 7))  # one short line, a line of 49 words
    assert got[8] == ""


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(5, 30), rng.choice(["a"] * 6 + ["b", "c"]), rng.choice(["x", "y"])) for i in range(4000)] + [(-1, None, None, None), (None, "a b", "a", "x"), (-2, "", "a", "x")]
    schema = "doc_id long, text string, source string, lang string"
    targets = {"source": Target(shares={"a": 0.4, "b": 0.3, "c": 0.3}), "lang": Target(shares={"x": 0.7, "y": 0.3}), "topic": Target(1.0)}
    out = mix(docs(spark, rows, schema).withColumn("tokens", F.lit(1)), targets).toPandas()
    assert len(out) == len(rows) and out.p_keep.max() == pytest.approx(1)
    kept = out[out.kept]
    for column, share in (("source", {"a": 0.4, "b": 0.3, "c": 0.3}), ("lang", {"x": 0.7, "y": 0.3})):
        got = kept.groupby(column).n_tokens.sum() / kept.n_tokens.sum()
        assert all(abs(got[k] - v) < 0.05 for k, v in share.items())
    assert not out[out.n_tokens == 0].kept.any()
    own = mix(docs(spark, [(i, "w " * (10 + i % 7), "a", "x", "t1" if i % 4 else "t2") for i in range(2000)], schema + ", topic string"), {**targets, "source": Target(), "lang": Target(), "topic": Target(shares={"t1": 0.5, "t2": 0.5})}).where("kept").groupBy("topic").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.topic for r in own} == {"t1", "t2"} and max(r.n for r in own) / sum(r.n for r in own) < 0.56
    assert mix(docs(spark, [], schema).where("false")).count() == 0


CELLS = "source string, lang string, topic string, tokens long"


def test_rake_by_windows_and_by_grouped_sums(spark):
    rng = random.Random(5)
    cells = docs(spark, [(f"s{i}", f"l{j}", f"t{k}", rng.randint(1, 900) ** 2) for i in range(5) for j in range(4) for k in range(3) if rng.random() < 0.8], CELLS)
    one, many = (sorted(rake(cells, DEFAULT, most_cells=m).collect()) for m in (100, 0))
    assert all(a[:4] == b[:4] and a.w == pytest.approx(b.w, rel=1e-9) and a.p_keep == pytest.approx(b.p_keep, rel=1e-9) for a, b in zip(one, many, strict=True))
    assert max(r.p_keep for r in one) == 1
    error = marginal_error(rake(cells, DEFAULT), DEFAULT).collect()
    rows = cells.collect()
    for axis in ("source", "lang", "topic"):
        own = Counter()
        for r in rows:
            own[r[axis]] += r.tokens
        power = {k: (v / sum(own.values())) ** DEFAULT[axis].power for k, v in own.items()}
        got = {r.name: r for r in error if r.axis == axis}
        assert set(got) == set(own)
        assert all(got[k].target == pytest.approx(v / sum(power.values())) and abs(got[k].share - got[k].target) < 0.01 for k, v in power.items())


def test_rake_with_targets_of_nothing(spark):
    """A language whose only source has no share has no weight; targets that contradict each other are warned of."""
    rows = [(1, "a b c", "a", "x"), (2, "a b c", "c", "z"), (3, "d e", "b", "x"), (4, "long " * 99, "c", "z"), (4, "long " * 99, "c", "z")]
    table = docs(spark, rows, "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="from its target"):
        got = mix(table, {**DEFAULT, "source": Target(shares={"a": 0.5, "b": 0.5})}).collect()
    assert {r.source: r.p_keep for r in got if r.source == "c"} == {"c": 0} and any(r.p_keep == 1 for r in got)
    with pytest.warns(UserWarning):
        assert not any(r.kept for r in mix(table, {**DEFAULT, "source": Target(shares={"elsewhere": 1.0})}).collect())


def test_classifier_held_out_accuracy_and_odd(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(60))
    bad = lambda: rng.choice([good().upper() + "!!", " ".join(w + "%%%" for w in good().split()), "spam " * 60])
    rows = [(i, good() if i % 4 else bad(), "s" if i % 3 else f"t{i}", "en") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    odd = [(1000, None, None, None), (1001, "", "s", None)]
    schema = "doc_id long, text string, source string, lang string"
    out = {r.doc_id: r for r in classify(docs(spark, rows + odd, schema).withColumn("kept", F.lit("old")), labels, F.col("source"), F.col("lang")).collect()}
    assert len(out) == len(rows) + 2
    held = [out[i].kept == (i % 4 > 0) for i in range(200, 400)]
    assert sum(held) / len(held) > 0.95
    assert classify(docs(spark, [], schema).where("false"), labels, F.col("source"), F.col("lang")).count() == 0
    none = classify(docs(spark, rows[:5], schema), labels.where("false"), F.col("source"), F.col("lang")).collect()
    assert [r.evidence for r in none] == [0.0] * 5


def test_classifier_against_plain_sums(spark):
    """Rates and posteriors from the evidence, by plain sums over the other documents."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 7))) * (1 + (i % 5 == 0) * 4) for _ in range(rng.randint(1, 50))), rng.choice("aaab") + str(i % 40 // 39), rng.choice(["x", "y", None])) for i in range(300)]
    rows += [rows[4], rows[4], (900, "alone there", "only", "x")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    out = classify(docs(spark, rows, "doc_id long, text string, source string, lang string"), labels, F.col("source"), F.col("lang")).collect()
    assert len(out) == len(rows)
    y = [i % 5 > 0 for i in range(150)] + [True] + [True, True]  # row 4 is there three times
    share = sum(y) / len(y)
    p = [1 / (1 + math.exp(-(r.evidence + math.log(share / (1 - share))))) for r in out]
    n = len(out)
    site, path = {}, {}
    for r, x in zip(out, p, strict=True):
        for d, k in ((site, r.source), (path, (r.source, r.lang))):
            s, c = d.get(k, (0.0, 0))
            d[k] = s + x, c + 1

    def strength(groups):
        num = sum(c * (s / c - m) ** 2 for s, c, m in groups) - sum(m * (1 - m) for _, _, m in groups)
        total = sum(c for _, c, _ in groups)
        between, within = num / total, sum(m * (1 - m) * c for _, c, m in groups) / total
        return 10_000.0 if between <= 0 else min(10_000.0, max(1.0, within / between - 1))

    overall = sum(p) / n
    a = strength([(s, c, overall) for s, c in site.values()])
    mean = {k: (s + a * overall) / (c + a) for k, (s, c) in site.items()}
    b = strength([(s, c, mean[k[0]]) for k, (s, c) in path.items()])
    for r, x in zip(out, p, strict=True):
        rest = (sum(p) - x + share) / n
        (s, c), (t, e) = site[r.source], path[r.source, r.lang]
        own_site = (s - x + a * rest) / (c - 1 + a)
        own_path = (t - x + b * own_site) / (e - 1 + b)
        want = 1 / (1 + math.exp(-(r.evidence + math.log(own_path / (1 - own_path)))))
        assert (r.site_rate, r.path_rate, r.posterior) == pytest.approx((own_site, own_path, want), rel=1e-6)


def test_rules_against_plain_expectation_maximisation(spark):
    """Posteriors by plain loops over documents instead of patterns."""
    from sheaf.llm.quality_rules import RULES

    from tests.conftest import SF

    out = judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    votes, size = [list(r.votes) for r in out], len(RULES)
    m, gp, gn, bp, bn = 0.8, [0.7] * size, [0.02] * size, [0.3] * size, [0.3] * size

    def good(v):
        side = lambda prior, p, n: math.log(prior) + sum(math.log(p[k] if x == 1 else n[k] if x == -1 else max(1 - p[k] - n[k], 1e-9)) for k, x in enumerate(v))
        return 1 / (1 + math.exp(side(1 - m, bp, bn) - side(m, gp, gn)))

    for _ in range(12):
        q = [good(v) for v in votes]
        rate = lambda w, k, x: (sum(a for a, v in zip(w, votes, strict=True) if v[k] == x) + 1) / (sum(w) + 3)
        bad = [1 - x for x in q]
        m = (sum(q) + 1) / (len(q) + 2)
        gp, gn, bp, bn = ([rate(w, k, x) for k in range(size)] for w, x in ((q, 1), (q, -1), (bad, 1), (bad, -1)))
    for r, v in zip(out, votes, strict=True):
        assert r.quality == pytest.approx(good(v), rel=1e-6, abs=1e-9)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_fit_separates():
    x = np.r_[np.zeros((50, 2)), np.ones((50, 2))] + np.random.default_rng(0).normal(0, 0.1, (100, 2))
    m = fit(x, np.r_[np.zeros(50), np.ones(50)])
    assert sum(m.weights) > 0


def test_lm_base_counts_and_probabilities(spark):
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(30)]
    rows = [(i, " ".join(vocab[min(29, int(rng.expovariate(0.2)))] for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "unseen words only"), (7, "w1 w2"), (None, "W1 é"), (1003, "w1 " * 20000)]
    got = LM.score_documents(docs(spark, rows).withColumn("block", F.lit(0)), block_tokens=500, bucket_keys=50).collect()
    assert len(got) == len(rows)
    tokens = [(d, [*words(t), None]) for d, t in rows]
    train = Counter(w for d, ts in tokens if crc("" if d is None else d) % 10 for w in ts)
    n, v = sum(train.values()), len(train)
    want = Counter((d, crc("" if d is None else d) % 10 == 0, len(ts), sum(train[w] > 0 for w in ts), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), 4)) for d, ts in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 1
    assert LM.score_documents(docs(spark, []).where("false")).count() == 0


def test_lm_counts_keep_bigrams_with_near_keys_apart(spark):
    import xxhash

    vocab = [f"v{i}" for i in range(3000)]
    key = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in vocab], np.uint64)
    pairs = LM.mix64(np.repeat(key, len(key)), np.tile(key, len(key)))
    order = np.argsort(pairs)
    same = np.flatnonzero(np.diff(pairs[order] >> np.uint64(24)) == 0)
    assert len(same)  # bigrams whose keys have their first 40 bits in common
    texts = [f"{vocab[i // len(vocab)]} {vocab[i % len(vocab)]}" for at in same for i in order[at : at + 2].tolist()]
    ids = [d for d in range(1000) if LM.split_of(d) == LM.TRAIN][: len(texts)]
    answers = LM.answer(LM.ask(LM.build_blocks(docs(spark, list(zip(ids, texts, strict=True))), 10**6), 2, [1, 1])).where("gram = 1").collect()
    seen = {b for t in texts for w in [[None, *t.split(), ""]] for b in zip(w, w[1:])}
    assert sum(r.n_distinct for r in answers) == len(seen)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_match_plain_deleted_interpolation(spark, order):
    """Scores from plain dictionaries with the weights that EM finds on the same table of ratios."""
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 20)))) for i in range(120)]
    caught = {}
    learn = LM.learn_weights
    LM.learn_weights = lambda table, o, rounds=50: caught.setdefault("w", learn(table, o, rounds))
    try:
        got = {r.doc_id: r.score for r in LM.score_documents(docs(spark, rows), order=order, block_tokens=100, bucket_keys=20).collect()}
    finally:
        LM.learn_weights = learn
    grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    padded = {d: ["<s>"] * (order - 1) + words(t) + ["</s>"] for d, t in rows}
    for d, ts in padded.items():
        if crc(d) % 10:
            for i in range(order - 1, len(ts)):
                for k in range(order):
                    grams[k][tuple(ts[i - k : i + 1])] += 1
                    contexts[k][tuple(ts[i - k : i])] += 1
    n, v = contexts[0][()], len(grams[0])
    for d, ts in padded.items():
        total = 0.0
        for i in range(order - 1, len(ts)):
            c = [contexts[k][tuple(ts[i - k : i])] for k in range(order)]
            w = caught["w"][int(LM.frequency_bucket(np.array([float(c[-1])]))[0])]
            p = [1 / (v + 1), *(grams[k][tuple(ts[i - k : i + 1])] / c[k] if c[k] else None for k in range(order))]
            use = [(a, b) for a, b in zip(w, p, strict=True) if b is not None]
            total += math.log10(sum(a * b for a, b in use) / sum(a for a, _ in use))
        assert got[d] == pytest.approx(total, rel=1e-6)
