"""Candidates, containment, time lines, interval and as-of joins against brute force, with hot keys and odd cases."""

import random
import re
from collections import Counter
from math import floor, log

import pytest
from pyspark.sql import functions as F
from sheaf.operators import asof, candidates, containment, timeline
from sheaf.operators.candidates import top_candidates


def best(profiles, jobs, k):
    had = {}
    for d, s in profiles:
        had.setdefault(d, set()).update(x for x in s or () if x is not None)
    had.pop(None, None)
    had = {d: own for d, own in had.items() if own}
    asked = {}
    for j, s in jobs:
        asked.setdefault(j, set()).update(x for x in s or () if x is not None)
    asked.pop(None, None)
    df = Counter(x for s in had.values() for x in s)
    w = {x: floor(1_000_000 * log(1 + len(had) / n)) for x, n in df.items()}
    out = set()
    for j, s in asked.items():
        scored = sorted((-sum(w[x] for x in s & own), d) for d, own in had.items() if s & own)
        out |= {(j, r + 1, d, -v) for r, (v, d) in enumerate(scored[:k])}
    return out


def some_people(seed, n_profiles, n_jobs):
    """Skills with a long tail; the first is had by a third of all and asked for by a third; some jobs ask for it alone."""
    r = random.Random(seed)
    skill = lambda: f"s{int(600 ** r.random()) - 1}"
    own = lambda n: [skill() for _ in range(n)] + (["s0"] if r.random() < 0.3 else [])
    profiles = [(i, own(r.randrange(1, 15))) for i in range(n_profiles)]
    jobs = [(i, ["s0"] if i % 9 == 0 else ["s0", "s1"] if i % 9 == 1 else own(r.randrange(1, 8))) for i in range(n_jobs)]
    odd = [(5, ["s0", None, "s3"]), (None, ["s1"]), (n_profiles, None), (n_profiles + 1, []), (7, ["other"])]
    return profiles + odd, jobs + [(n_jobs, ["unheard of"]), (n_jobs + 1, None), (None, ["s0"]), (3, ["s2"])]


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, skills array<string>")


@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_candidates_against_all_pairs(spark, k):
    profiles, jobs = some_people(k, 700, 80)
    p, j = table(spark, profiles, "doc_id"), table(spark, jobs, "job_id")
    assert {tuple(r) for r in top_candidates(p, j, k).collect()} == best(profiles, jobs, k)


def test_top_candidates_dealt_in_small_parts(spark):
    profiles, jobs = some_people(9, 500, 90)
    terms, own, kinds = candidates.index(table(spark, profiles, "doc_id"), table(spark, jobs, "job_id"), "doc_id", "job_id", "skills")
    found = candidates.compared(terms, own, kinds, 4, posting_rows=20, job_rows=5).collect()
    scores = {}
    for r in found:
        assert (r.j, r.p) not in scores
        scores[r.j, r.p] = r.score
    want = best(profiles, jobs, 4)
    assert {(j, d): v for j, _, d, v in want}.items() <= scores.items()


def test_top_candidates_make_no_pairs(spark):
    """10,000 profiles and 1,000 jobs: equal to brute force, and few rows leave the join."""
    profiles, jobs = some_people(3, 10_000, 1_000)
    p, j = table(spark, profiles, "doc_id"), table(spark, jobs, "job_id")
    out = top_candidates(p, j, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {tuple(r) for r in out.collect()} == best(profiles, jobs, 5)
    terms, own, kinds = candidates.index(p, j, "doc_id", "job_id", "skills")
    assert candidates.compared(terms, own, kinds, 5).count() < 100_000  # of ten million pairs


def test_top_candidates_compare_copies_once_and_blocks_agree(spark):
    """Profiles and jobs in twenty copies: the same best as of all pairs; blocks of few skills give what one block gives."""
    profiles, jobs = some_people(5, 120, 40)
    many = lambda rows: [(None if i is None else i + 1_000 * c, s) for c in range(20) for i, s in rows]
    got = top_candidates(table(spark, many(profiles), "doc_id"), table(spark, many(jobs), "job_id"), 30)
    assert {tuple(r) for r in got.collect()} == best(many(profiles), many(jobs), 30)
    rows = lambda x, n: [(i, sorted({hash_of(v) for v in own or () if v})) for i, (_, own) in enumerate(x[:n])]
    hash_of = lambda v: int(v[1:])
    c = spark.createDataFrame([(i, i, s) for i, s in rows(profiles, 120)], "c long, first long, sids array<long>")
    j = spark.createDataFrame([(i, s, [7 + v for v in s]) for i, s in rows(jobs, 40)], "jc long, sids array<long>, ws array<long>")
    one, small = ({tuple(r) for r in candidates.best_of_blocks(c, j, 4, n).collect()} for n in (10_000, 50))
    assert one == small and len(one) > 100


@pytest.mark.parametrize("k", [1, 4])
def test_jobs_counted_by_bits_are_those_of_posting_lists(spark, k):
    """Weights that differ much and weights alike, ties, more profiles than a word of bits: planes, posting lists and brute force agree."""
    import numpy as np

    r = np.random.default_rng(k)
    for n in (1, 64, 500):
        has = r.random((18, n)) < r.random((18, 1)) / 2
        bits = np.zeros((18, -(-n // 64)), "uint64")
        for i, x in enumerate(has):
            bits[i] = np.packbits(np.append(x, np.zeros(-n % 64, bool)), bitorder="little").view("uint64")
        for m in (1, 2, 5, 15):
            rows = np.array([r.permutation(18)[:m] for _ in range(7)])
            for low in (1, 4000):
                ws = low + r.integers(0, 5, (7, m))
                job, place, score, _ = candidates._by_bits(rows, ws, bits, k, m + 1)
                for i in range(7):
                    all_scores = ws[i] @ has[rows[i]].astype("int64")
                    want = [x for x in np.argsort(-all_scores, kind="stable") if all_scores[x]][:k]
                    assert list(place[job == i]) == want and list(score[job == i]) == list(all_scores[want])
                    if want:
                        assert list(candidates._by_postings([np.flatnonzero(has[x]) for x in rows[i]], ws[i], n, k)[0]) == want
    profiles, jobs = some_people(11, 300, 60)
    ids = lambda x: [(i, sorted({int(v[1:]) for v in own or () if v and v != "other"})) for i, (_, own) in enumerate(x) if own]
    c = spark.createDataFrame([(i, 1_000 - i, s) for i, s in ids(profiles[:300])], "c long, first long, sids array<long>")
    j = spark.createDataFrame([(i, s, [7 + v for v in s]) for i, s in ids(jobs[:60])], "jc long, sids array<long>, ws array<long>")
    by_bits, by_postings = ({tuple(x) for x in candidates.best_of_blocks(c, j, k, bit_bytes=b).collect()} for b in (10**6, 0))
    assert by_bits == by_postings and len(by_bits) > 50


def test_profiles_without_any_asked_skill_count_as_profiles(spark):
    """Their number weighs the skills; rows that share a key are one profile, also where only one of them has an asked skill."""
    profiles = [(1, ["a", "b"]), (1, ["c"]), (2, ["x"]), (2, ["y"]), (3, ["a"]), (4, []), (5, [None])]
    jobs = [(1, ["a", "b"]), (2, ["c", "c", None]), (2, ["a"])]
    got = top_candidates(table(spark, profiles, "doc_id"), table(spark, jobs, "job_id"), 2)
    assert {tuple(r) for r in got.collect()} == best(profiles, jobs, 2)


def test_top_candidates_of_empty_tables(spark):
    none, some = table(spark, [], "doc_id"), table(spark, [(1, ["a"])], "job_id")
    assert top_candidates(none, some, 3).collect() == []
    assert top_candidates(some.withColumnRenamed("job_id", "doc_id"), table(spark, [], "job_id"), 3).collect() == []


def norm(x):
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip()


def test_containment_at_any_length(spark):
    r = random.Random(4)
    words = [a + b for a in "abc" for b in "xyz"] + ["Ab", "É", "x-y"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(80)] + [(3, "ax bx"), (None, "ax bx cy"), (100, None), (101, ""), (102, "ax " * 30_000), (103, "日本")]
    whole = [d[1] for d in docs[:80] if d[1]]
    needles = [(i, text(r.randrange(1, 5))) for i in range(40)] + [(40 + i, " ".join(x.split()[2:13])[1:]) for i, x in enumerate(whole[:30])] + [(90, "a"), (91, "a"), (92, "日本"), (93, None), (None, "bx"), (94, "x b")]
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "needle long, text string")
    want = Counter((a, b) for a, t in docs for b, s in needles if t is not None and s is not None and norm(s) in norm(t))
    blank = {b for b, s in needles if s is not None and not norm(s)}
    for block, empty in ((1_000_000, True), (30, False)):
        got = Counter(tuple(x) for x in containment.contained(d, n, "doc_id", "needle", block_chars=block, empty=empty).collect())
        assert got == (want if empty else Counter({k: v for k, v in want.items() if k[1] not in blank}))
    assert containment.contained(d.limit(0), n, "doc_id", "needle").count() == 0 and containment.contained(d, n.limit(0), "doc_id", "needle").count() == 0


def test_sums_of_contained_texts_make_no_row_for_each_needle(spark):
    """10,000 needles of two texts in 300 documents: as many rows as documents and texts meet the sums, not three million pairs."""
    docs = spark.createDataFrame([(i % 290, f"Doc {i} red bolt" + (" blue nut" if i % 2 else "")) for i in range(300)] + [(None, "red bolt"), (7, None), (8, "none")], "doc_id long, text string")
    needles = spark.createDataFrame([(i, ("Red bolt!", "blue  nut", "gone")[i % 3]) for i in range(9_000)] + [(None, "red bolt"), (-1, "日本"), (-2, None)], "needle long, text string")
    got = containment.contained_sums(docs, needles, "doc_id", "needle")
    want = containment.contained(docs, needles, "doc_id", "needle").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("needle").alias("total"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in want.collect())
    hits, _, _ = containment._found(docs, needles, "doc_id", "needle", "text", 1_000)
    assert hits.count() == 300 + 150 + 1


DATES = [("Jan 2018", "Mar 2018", 24216, 24219), ("2018", "2018", 24216, 24228), ("since 2018", "present", 24216, 24237), ("Sept 2018", "Now", 24224, 24237), ("2019", "2018", None, None), (None, "2018", None, None), ("x", "2018", None, None), ("December 2018", "current", 24227, 24237), ("2018", "", None, None)]


def test_months(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(DATES)], "id int, start_date string, end_date string")
    out = timeline.spans(rows, F.lit("2019-09-30").cast("date")).orderBy("id").collect()
    assert [(r.first_month, r.past_month) for r in out] == [(c, d) for _, _, c, d in DATES]


def some_intervals(seed, n):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3, None]), i, a := r.randrange(24000, 24300), a + int(200 ** r.random())) for i in range(n)] + [(4, n, None, None), (5, n + 1, 0, 119_000), (5, n + 2, 24000, 24001), (1, n + 3, 24000, 24000)]


def test_time_lines_against_sets_of_months(spark):
    rows = some_intervals(0, 60)[:-1]
    lines = {r.k: r for r in timeline.time_lines(spark.createDataFrame(rows, "k long, i int, first_month int, past_month int"), ["k"]).collect()}
    for k in {x[0] for x in rows}:
        own = [(a, b) for x, _, a, b in rows if x == k and a is not None]
        months = sorted({m for a, b in own for m in range(a, b)})
        gaps = [b - a - 1 for a, b in zip(months, months[1:]) if b - a > 1]
        got = lines[k]
        assert (got.n_items, got.n_dated, got.months, got.months_doubled) == (sum(x[0] == k for x in rows), len(own), len(months), sum(b - a for a, b in own) - len(months))
        assert (got.n_stretches, got.months_of_gaps, got.longest_gap) == ((len(gaps) + 1 if months else 0), sum(gaps), max(gaps, default=0))


def test_overlaps_against_all_pairs(spark):
    left, right = some_intervals(1, 200), some_intervals(2, 200)
    a, b = (spark.createDataFrame(x, "k long, i int, first_month int, past_month int") for x in (left, right))
    full = lambda x: x[0] is not None and x[2] is not None and x[2] < x[3]
    want = Counter((x[0], x[1], y[1]) for x in filter(full, left) for y in filter(full, right) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert Counter(tuple(r) for r in timeline.overlaps(a, b, ["k"]).select("k", "l.i", "r.i").collect()) == want
    any_key = Counter((x[1], y[1]) for x in left for y in right if x[2] is not None and y[2] is not None and max(x[2], y[2]) < min(x[3], y[3]))
    assert Counter(tuple(r) for r in timeline.overlaps(a, b, []).select("l.i", "r.i").collect()) == any_key


@pytest.mark.parametrize("slice_points", [1_000_000, 7])
def test_asof_against_plain(spark, slice_points):
    r = random.Random(slice_points)
    left = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice([r.randrange(200), 50, None])) for i in range(300)]
    right = [(r.choice(["a", "a", "b", None]), r.choice([r.randrange(20, 200), 60, None]), r.randrange(1000), r.choice(["x", None])) for i in range(200)]
    got = asof.asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, at int, p int, v string"), ["k"], "t", "at", {"v": "found", "p": "by"}, ["p"], slice_points)
    assert got.columns == ["i", "k", "t", "found", "by"]
    for x in (rows := got.collect()):
        can = [y for y in right if x.k is not None and x.t is not None and y[0] == x.k and y[1] is not None and y[1] <= x.t]
        want = max(can, key=lambda y: (y[1], y[2], y[3] is not None, y[3] or ""), default=(None, None, None, None))
        assert (x.found, x.by) == (want[3], want[2])
    assert len(rows) == len(left)


def test_workflow_with_the_best_profiles_of_each_job(spark):
    from sheaf.plans import workflow as W
    from sheaf.plans import workflow_queries as Q

    cvs = spark.createDataFrame([(1, "Ann\nSkills\n- Go\n- SQL"), (2, "Bo\nExperience\nDev\\tX Corp\\tMay 2018 - May 2019\n- a\n- b\n\nSkills\n- go!\n- Rust\n- C".replace("\\t", "\t")), (3, "Cy\nExperience\nDev\tY Corp\tMay 2018 - May 2019\n- a\n- b\nSkills\n- GO\n- Perl\n- SQL")], "doc_id long, text string")
    jobs = spark.createDataFrame([(1, "Go Rust"), (2, "Perl SQL"), (3, "Cobol")], "job_id long, text string")
    run = W.analyze(spark, cvs, jobs, Q.PROVIDER, generated_at=Q.AT, best=1)
    assert {(r.doc_id, r.job_id) for r in run.runs.select("doc_id", "job_id").collect()} == {(2, 1), (3, 2)}
    assert run.quarantine.where("key = '1'").count() == 1  # fewer than three skills: no candidate


@pytest.mark.parametrize("name", ["cli2_build_profiles", "wfl1_cross_profile_job", "val8_whole_run"])
def test_orders_without_line_items_are_orders_all_the_same(spark, tmp_path, name):
    """Of every second customer only one order has line items left, and of some none: the SQL counts orders."""
    import shutil

    import duckdb
    from sheaf.plans.registry import ORACLES, QUERIES

    from tests.conftest import SF
    from tests.oracle import check

    sf = str(tmp_path / "sf")
    shutil.copytree(SF, sf, copy_function=shutil.copyfile)
    kept = f"select * from '{SF}/lineitem.parquet' where l_orderkey in (select case when o_custkey % 2 = 1 or o_orderkey = m then o_orderkey end from (select *, min(o_orderkey) over (partition by o_custkey) m from '{SF}/orders.parquet') where o_orderkey is not null)"
    duckdb.sql(f"copy ({kept}) to '{sf}/lineitem.parquet' (format parquet)")
    check(QUERIES[name], ORACLES[name], spark, sf)
