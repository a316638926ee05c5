"""Conversation repair against exhaustive search, a plain version of whole conversations, and odd cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from sheaf.llm import conversation_repair as C

from tests.conftest import SF
from tests.oracle import database

SPACE = " \t\n\x0b\f\r"


def outputs(symbols, audit):
    """(cost, role initials that come out or None) for all readings of an edit string: R and I may give u or a."""
    free = [i for i, e in enumerate(audit) if e in "RI"]
    for choice in itertools.product("ua", repeat=len(free)):
        pick, left, cost, out = dict(zip(free, choice)), iter(symbols), 0, ""
        for i, e in enumerate(audit):
            x = None if e == "I" else next(left)
            if e == "D":
                cost += 3
            elif e == "I":
                cost, out = cost + 2, out + pick[i]
            elif x == "x":
                break
            else:
                cost += x.isupper() + 2 * (e == "R")
                out += x.lower() if e == "K" else pick[i]
        else:
            yield cost, out


def exhaustive(symbols, most_insertions=3):
    best = None
    for n in range(most_insertions + 1):
        for spots in itertools.combinations_with_replacement(range(len(symbols) + 1), n):
            for own in itertools.product("KRD", repeat=len(symbols)):
                audit = "".join("I" * spots.count(i) + (own[i] if i < len(symbols) else "") for i in range(len(symbols) + 1))
                for cost, out in outputs(symbols, audit):
                    if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_least_path_against_all_edit_strings(seed):
    r = random.Random(seed)
    for _ in range(25):
        symbols = "".join(r.choice("sSuUaAox") for _ in range(r.randrange(5)))
        assert min(p for p in (C.least_paths(symbols, 0)[q] for q in C.ENDS) if p) == exhaustive(symbols), symbols


def by_heap(symbols):
    """Cheapest first over (place, initials that came out by type), strings and all."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    todo, done = [(0, "", 0, "")], set()
    while todo:
        cost, audit, i, last = heapq.heappop(todo)
        if i == len(symbols) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        arcs = [(2, "I", i, r) for r in "ua"]
        if i < len(symbols):
            x = symbols[i]
            arcs.append((3, "D", i + 1, None))
            if x != "x":
                arcs += [(x.isupper() + 2 * (e == "R"), e, i + 1, o) for e, o in (("K", x.lower()), ("R", "u"), ("R", "a"))]
        for more, e, j, out in arcs:
            after = last if out is None else step.get((last, out))
            if after is not None:
                heapq.heappush(todo, (cost + more, audit + e, j, after))


def plain(rows):
    """(turn, role, text) rows in order to a result row."""
    symbols, seen, faults = "", set(), [0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        k = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        if k is not None:
            faults[k] += 1
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("u", "a", "s") else "o"
        symbols += "x" if k in (0, 1) else initial.upper() if k == 2 else initial
    cost, audit = by_heap(symbols)
    left, out = iter(rows), []
    for e in audit:
        role, text = ("", "") if e == "I" else next(left)[1:]
        if e in "IR":
            role = "assistant" if out and out[-1].startswith("u") else "user"
        if e != "D":
            out.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    """conv_id -> rows after damage, in order."""
    spaced = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def some_rows(seed):
    r = random.Random(seed)
    texts = ["Yes.", "Yes.", "no", "Well, then!", " \t", "", None, "a\nb?", "long " * 300 + ".", "tail. \n", "\x85", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "User", ""]
    rows = [(c, t if r.random() > 0.1 else r.choice((None, 3)), roles[(t + 1) % 2 + 2 * (r.random() < 0.2)] if r.random() > 0.2 else r.choice(roles), r.choice(texts)) for c in [*range(60), None] for t in range(r.randrange(1, 9))]
    rows += [(777, t // 2, "user" if t % 2 else "assistant", f"turn {t % 50}{r.choice('.?x')}") for t in range(300)] + [(778, 5, "user", "same.")] * 40 + [(779, None, "user", "q?"), (779, None, "user", "r?")]
    return rows + rows[:4]


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"chunk_rows": 3, "partitions": 7}), (2, {"chunk_rows": 10, "chunk_chars": 2000, "partitions": 40})])
def test_repair_against_plain(spark, seed, options):
    rows = some_rows(seed)
    given = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, part string, _place int").repartition(5)
    got = results(C.repair(C.damage(given), **options))
    assert got == {k: plain(v) for k, v in damaged(rows).items()}


def test_messages_by_parts(spark):
    rows = some_rows(3)
    given = C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = results(C.repair(given))
    parts = {}
    for r in C.repaired_messages(given, chunk_rows=4, partitions=9).orderBy("part").collect():
        parts.setdefault(r.conv_id, []).extend(f"{m.role}:{m.text}" for m in r.messages)
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in parts.items()} == {k: v[-1] for k, v in want.items()}


def test_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert C.repair(C.damage(spark.createDataFrame([], schema))).collect() == []
    dropped = next(i for i in range(100) if zlib.crc32(f"c:{i}".encode()) % 20 == 0)
    got = results(C.repair(C.damage(spark.createDataFrame([("c", dropped, "user", "x.")], schema))))
    assert got == {"c": (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    raw = spark.createDataFrame([("c", 1, None, "x.", None), ("c", 2, "user", None, False)], f"{schema}, gone boolean")
    assert results(C.repair(raw)) == {"c": plain([(1, "", "x."), (2, "user", "")])}


def test_query_on_the_tables(spark):
    from sheaf.llm.queries import op13_conversation_repair

    rows = database(SF).execute("select conv_id, turn, role, text from conversations").fetchall()
    assert results(op13_conversation_repair(spark, SF)) == {k: plain(v) for k, v in damaged(rows).items()}
