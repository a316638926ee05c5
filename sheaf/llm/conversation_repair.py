"""Repairing the structure of conversations by weighted finite-state composition.

A conversation's rows, in order of their turns, are an input acceptor: one symbol for each row, which tells the
initial of its role, and whether it must go or is cut short. The edit transducer reads it and keeps,
re-roles, deletes or inserts rows at a cost; the grammar acceptor takes the role initials that come out,
``(s?(ua)+)?``. The three are composed lazily: only pairs of a row's place and a grammar state that are
reached exist, and as rows only go forward, places are a topological order for the shortest path. Its weights are
lexicographic: cost, then the string of edit initials. (Two paths to one pair with the same cost never have
strings of which one begins the other: the rest would be insertions, which cost. So the order of strings stays
when both go on, and the least path is made of least paths.)

At scale: rows are dealt out by ranges of (conversation, turn, role, text, place in the input), so a range can be cut anywhere, also
in a hot conversation or among equal rows; the text moves once. A conversation that lies within one range and is no longer than
``chunk_rows`` is repaired there. What is cut by ranges or longer is cut into chunks: first places of
equal rows come from a grouping; each chunk gives the least path from every grammar state to every other, a
small matrix; one conversation's matrices are multiplied in order, which gives the states between chunks; chunks then write
their repaired rows side by side. Only SHA-256, which reads its input in order, goes over one conversation's
chunks in one task, as a stream.

Nulls: in ``damage``, a null conv_id, turn, role or text counts as one space; rows of a null conv_id are one conversation
and null turns come first; in ``repair``, a null role or text is an empty one. Rows of one turn are in the order of role, first 64 characters, then a hash of the text; rows that are equal in all are
repeats, duplicates but for the first. An empty role, or one of another initial than s, u, a, fits the grammar nowhere. Empty texts are blank; long ones are
taken whole. An empty table gives an empty result. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import SPACE_CHARS, materialize, release

#: The grammar acceptor: states by what came last (0: nothing), and those where a conversation may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
N_STATES = len(GRAMMAR)
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols of rows: the initial of the role (o: another), a capital where the text is cut short; x: must go.
GONE = "x"

MESSAGES = "array<struct<role:string,text:string>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
Path = tuple[int, str]


@lru_cache(maxsize=64)
def edits(symbol: str) -> tuple[tuple[str, str, int], ...]:
    """Arcs of the edit transducer that read a symbol: (label, initial that comes out or none, cost)."""
    out = [("D", "", DELETE)]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        out += [("K", symbol.lower(), KEEP + more), *(("R", r, REROLE + more) for r in ROLES)]
    return tuple(out)


def _with_insertions(best: dict[int, Path]) -> dict[int, Path]:
    """The pairs reached from those given by arcs that read nothing."""
    todo = list(best)
    while todo:
        state = todo.pop()
        cost, label = best[state]
        for initial, after in GRAMMAR[state].items():
            found = (cost + INSERT, label + "I")
            if initial in ROLES and (after not in best or found < best[after]):
                best[after] = found
                todo.append(after)
    return best


@lru_cache(maxsize=100_000)
def least_paths(symbols: str, start: int) -> tuple[Path | None, ...]:
    """The least (cost, label string) over all rows from a grammar state to each."""
    best = _with_insertions({start: (0, "")})
    for symbol in symbols:
        reached: dict[int, Path] = {}
        for state, (cost, label) in best.items():
            for edit, initial, more in edits(symbol):
                after = GRAMMAR[state].get(initial) if initial else state
                if after is not None:
                    found = (cost + more, label + edit)
                    if after not in reached or found < reached[after]:
                        reached[after] = found
        best = _with_insertions(reached)
    return tuple(best.get(q) for q in range(N_STATES))


def apply_edits(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """(role, text) rows after the edits, from a grammar state on."""
    out, left = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else next(i for i in GRAMMAR[state] if i in ROLES)
        state = GRAMMAR[state][initial]
        out.append((role if edit == "K" else ROLES[initial], text))
    return out


class Rows:
    """Rows of a conversation, or of a chunk of it, in order, and what is counted of them."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.turns: list[int | None] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.turns.append(turn)
        self.size += len(text)

    def symbols(self, first: set[int]) -> tuple[str, tuple[int, int, int]]:
        """The symbols of the rows and how many are blank, duplicate and truncated. ``first``: places of rows with no equal before them."""
        out, blank, duplicate, truncated = [], 0, 0, 0
        for i, (role, text) in enumerate(self.rows):
            body = text.rstrip(SPACE_CHARS)
            if not body:
                blank += 1
                out.append(GONE)
            elif i not in first:
                duplicate += 1
                out.append(GONE)
            else:
                symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
                if body[-1] not in ".!?":
                    truncated += 1
                    symbol = symbol.upper()
                out.append(symbol)
        return "".join(out), (blank, duplicate, truncated)

    def own_firsts(self) -> set[int]:
        seen: dict[tuple[str, str], int] = {}
        for i, r in enumerate(self.rows):
            seen.setdefault(r, i)
        return set(seen.values())

    def illegal(self) -> int:
        initials = [role[:1] for role, _ in self.rows]
        return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))

    def turn_span(self) -> tuple[int | None, int | None, int]:
        """Smallest, largest and number of different turns."""
        own = [t for t in self.turns if t is not None]
        return (min(own), max(own), len(set(own))) if own else (None, None, 0)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: rows damaged by a hash of conv_id and turn. Rows that are dropped stay with ``gone``, so that every conversation does."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    role, text = F.when(kind == 4, "user").otherwise(spaced("role")), spaced("text")
    text = F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)).alias("copies"))
    return out.withColumn("_copy", F.explode("copies")).drop("copies", "_copy")


def _ordered(rows: DataFrame, partitions: int | None) -> DataFrame:
    """conv_id, turn, role, text, gone by ranges that may be cut anywhere, in order."""
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.substring("text", 1, 64).asc(), F.xxhash64("text").asc(), F.col("_place").asc()]
    placed = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")), F.coalesce("gone", F.lit(False)).alias("gone")).withColumn("_place", F.monotonically_increasing_id())
    return placed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).drop("_place")


def _segments(rows: DataFrame, chunk_rows: int, chunk_chars: int, partitions: int | None, messages: bool) -> DataFrame:
    """Conversations that were repaired where they lie (``part`` null), and chunks of the others: part and seq are their order."""
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    fields = [("part", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    fields += [("messages", message), ("turns", pa.list_(pa.int64())), ("rows", message)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, at_start, cut = 0, True, False  # cut: chunks of the current conversation were written before
        key = held = kind = None
        ready: list[tuple] = []
        size = 0

        def chunk(last: Rows) -> tuple:
            nonlocal seq
            seq += 1
            return (held, part, seq, *[None] * 9, last.turns, [{"role": r, "text": t} for r, t in last.rows])

        def whole(own: Rows) -> tuple:
            symbols, counts = own.symbols(own.own_firsts())
            paths = least_paths(symbols, 0) if len(symbols) <= 64 else least_paths.__wrapped__(symbols, 0)
            cost, audit = min(p for p in (paths[q] for q in ENDS) if p is not None)
            repaired = apply_edits(own.rows, audit, 0)
            low, high, n = own.turn_span()
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
            gaps = high - low + 1 - n if n else 0
            return (held, None, None, gaps, *counts, own.illegal(), cost, audit, digest, [{"role": r, "text": t} for r, t in repaired] if messages else None, None, None)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[0] for r in found], kind), *(pa.array([r[i + 1] for r in found], t) for i, (_, t) in enumerate(fields))]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *(n for n, _ in fields)])

        own = Rows()
        for batch in batches:
            kind = batch.column(0).type
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or conv != held:
                    if key is not None:
                        ready.append(chunk(own) if at_start or cut else whole(own))
                        at_start = False
                    own, key, held, cut = Rows(), True, conv, False
                elif len(own.rows) >= chunk_rows or own.size >= chunk_chars:
                    ready.append(chunk(own))
                    own, cut = Rows(), True
                if not gone:
                    own.add(turn, role, text)
                    size += len(text)
                if len(ready) >= 2000 or size > 4 * chunk_chars:
                    if ready:
                        yield batch_of(ready)
                    ready, size = [], own.size
        if key is not None:
            ready.append(chunk(own))
            yield batch_of(ready)

    ddl = f"{conv}, part int, seq int, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string, repaired_sha256 string, messages {MESSAGES}, turns array<long>, rows {MESSAGES}"
    return _ordered(rows, partitions).mapInArrow(run, ddl)


def _rows(turns: list, rows: list[dict]) -> Rows:
    out = Rows()
    for t, r in zip(turns, rows, strict=True):
        out.add(t, r["role"], r["text"])
    return out


def _matrices(chunks: DataFrame) -> DataFrame:
    """part, seq, conv_id, symbols, counts of each chunk, and the least path between any two grammar states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, seq, turns, rows, firsts in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "turns", "rows", "firsts")), strict=True):
                own = _rows(turns, rows)
                symbols, (blank, duplicate, truncated) = own.symbols(set(firsts or ()))
                paths = [p for q in range(N_STATES) for p in least_paths.__wrapped__(symbols, q)]
                low, high, n = own.turn_span()
                ends = [own.rows[0][0][:1], own.rows[-1][0][:1]] if own.rows else None
                out.append((part, seq, symbols, [blank, duplicate, truncated, own.illegal()], low, high, n, ends, [-1 if p is None else p[0] for p in paths], ["" if p is None else p[1] for p in paths]))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
            names = ["part", "seq", "symbols", "counts", "low", "high", "n_turns", "ends", "costs", "audits"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["conv_id", *names])

    conv = chunks.schema["conv_id"].dataType.simpleString()
    return chunks.mapInArrow(run, f"conv_id {conv}, part int, seq int, symbols string, counts array<long>, low long, high long, n_turns long, ends array<string>, costs array<long>, audits array<string>")


def _together(df: DataFrame) -> DataFrame:
    """A conversation's chunks in one task, in order."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def _composed(matrices: DataFrame) -> DataFrame:
    """For each conversation of several chunks: conv_id, first (its first chunk), counts, cost, audit, and for each chunk the states before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, some = None, None, False
        best: dict[int, Path] = {}
        back: list[tuple] = []
        sums, span, end = [0] * 4, [None, None, 0], None

        def result() -> tuple:
            cost, audit = min(best[q] for q in ENDS if q in best)
            state, states = next(q for q in ENDS if best.get(q) == (cost, audit)), []
            for part, seq, before in reversed(back):
                states.append({"part": part, "seq": seq, "start": before[state], "stop": state})
                state = before[state]
            low, high, n = span
            return (held, [back[0][0], back[0][1]], high - low + 1 - n if n else 0, *sums, cost, audit, states[::-1])

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.list_(pa.int32()), *[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([(c, pa.int32()) for c in ("part", "seq", "start", "stop")]))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["conv_id", "first", *COUNTS, "cost", "audit", "states"])

        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            names = ("conv_id", "part", "seq", "counts", "low", "high", "n_turns", "ends", "costs", "audits")
            for conv, part, seq, counts, low, high, n, ends, costs, audits in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not some or conv != held:
                    if some:
                        done.append(result())
                    held, some, best, back, sums, span, end = conv, True, {0: (0, "")}, [], [0] * 4, [None, None, 0], None
                reached: dict[int, Path] = {}
                before: dict[int, int] = {}
                for q, (cost, audit) in best.items():
                    for p in range(N_STATES):
                        if (more := costs[q * N_STATES + p]) >= 0:
                            found = (cost + more, audit + audits[q * N_STATES + p])
                            if p not in reached or found < reached[p]:
                                reached[p], before[p] = found, q
                best = reached
                back.append((part, seq, before))
                sums = [a + b for a, b in zip(sums, counts, strict=True)]
                if n:
                    # A turn on both sides of the border counts once.
                    span = [low if span[0] is None else span[0], high, span[2] + n - (span[1] == low)]
                if ends:
                    sums[3] += end is not None and end + ends[0] not in LEGAL
                    end = ends[1]
            if done:
                yield batch_of(done)
        if some:
            yield batch_of([result()])

    conv = matrices.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv}, first array<int>, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string, states array<struct<part:int,seq:int,start:int,stop:int>>"
    return _together(matrices).mapInArrow(run, ddl)


def _written(chunks: DataFrame) -> DataFrame:
    """conv_id, part, seq, messages: the repaired rows of each chunk between its two states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols, rows, start, stop in zip(*(batch.column(c).to_pylist() for c in ("symbols", "rows", "start", "stop")), strict=True):
                _, audit = least_paths.__wrapped__(symbols, start)[stop]
                out.append([{"role": r, "text": t} for r, t in apply_edits([(r["role"], r["text"]) for r in rows], audit, start)])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("seq"), pa.array(out, kind)], names=["conv_id", "part", "seq", "messages"])

    conv = chunks.schema["conv_id"].dataType.simpleString()
    return chunks.mapInArrow(run, f"conv_id {conv}, part int, seq int, messages {MESSAGES}")


def _digests(pieces: DataFrame) -> DataFrame:
    """first (part and seq of the first chunk) and repaired_sha256, over the pieces of each conversation as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, digest, begun = None, None, None, False

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.list_(pa.int32())), pa.array([r[1] for r in found], pa.string())], names=["first", "repaired_sha256"])

        for batch in batches:
            done = []
            for conv, part, seq, piece in zip(*(batch.column(c) for c in ("conv_id", "part", "seq", "piece")), strict=True):
                conv, piece = conv.as_py(), piece.as_py()
                if first is None or conv != held:
                    if first is not None:
                        done.append((first, digest.hexdigest()))
                    held, first, digest, begun = conv, [part.as_py(), seq.as_py()], hashlib.sha256(), False
                if piece is not None:
                    digest.update(b"\n" * begun + piece.encode())
                    begun = True
            if done:
                yield batch_of(done)
        if first is not None:
            yield batch_of([(first, digest.hexdigest())])

    return _together(pieces).mapInArrow(run, "first array<int>, repaired_sha256 string")


def _repaired(rows: DataFrame, chunk_rows: int, chunk_chars: int, partitions: int | None, messages: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Conversations repaired where they lay, those of several chunks (with ``first``), and the chunks' repaired rows."""
    staged = materialize(_segments(rows, chunk_rows, chunk_chars, partitions, messages), "segments")
    chunks = staged.where("part is not null").select("conv_id", "part", "seq", "turns", "rows")
    # The first of equal rows, over all chunks of a conversation.
    each = chunks.select("conv_id", "part", "seq", F.posexplode("rows").alias("i", "r"))
    equal = each.groupBy("conv_id", "r.role", F.sha2("r.text", 256).alias("h")).agg(F.min(F.struct("part", "seq", "i")).alias("f"))
    firsts = equal.groupBy("f.part", "f.seq").agg(F.collect_list("f.i").alias("firsts"))  # at most the rows of a chunk
    matrices = materialize(_matrices(chunks.join(firsts, ["part", "seq"], "left")), "matrices")
    composed = materialize(_composed(matrices), "composed")
    states = composed.select(F.inline("states"))
    written = materialize(_written(chunks.join(matrices.select("part", "seq", "symbols"), ["part", "seq"]).join(states, ["part", "seq"])), "repaired")
    release(matrices)
    return staged.where("part is null"), composed, written


def repair(rows: DataFrame, chunk_rows: int = 1000, chunk_chars: int = 1 << 22, partitions: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation. ``rows``: conv_id, turn, role, text, gone (as ``damage`` gives)."""
    closed, composed, written = _repaired(rows, chunk_rows, chunk_chars, partitions, False)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    pieces = written.select("conv_id", "part", "seq", F.when(F.size("messages") > 0, F.array_join(lines, "\n")).alias("piece"))
    out = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    return closed.select(*out).unionByName(composed.join(_digests(pieces), "first").select(*out))


def repaired_messages(rows: DataFrame, chunk_rows: int = 1000, chunk_chars: int = 1 << 22, partitions: int | None = None) -> DataFrame:
    """conv_id, part (from 0 in order, but not without gaps) and messages, the repaired rows. Conversations of up to ``chunk_rows`` rows mostly are one part."""
    closed, _, written = _repaired(rows, chunk_rows, chunk_chars, partitions, True)
    return closed.select("conv_id", F.lit(0).cast("long").alias("part"), "messages").unionByName(written.select("conv_id", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq")).alias("part"), "messages"))


def oracle_sql() -> str:
    """The result of ``repair`` of damaged conversations: least (cost, edits) by a fold over each conversation's rows with one weight for each grammar state."""
    space = r"[\x20\x09-\x0D]"

    def by(w: str, label: str, cost: str) -> str:
        return f"case when {w} is null then null else {{'c': {w}['c'] + {cost}, 's': {w}['s'] || '{label}'}} end"

    least = lambda *ws: f"list_min([{', '.join(ws)}])"
    inserted = lambda w: by(w, "I", str(INSERT))
    # Weights of the states 0 to 3 are a[1] to a[4]; insertions lead to 2, and from 2 to 3.
    two = lambda a: least(f"{a}[3]", *(inserted(f"{a}[{k}]") for k in (1, 2, 4)))
    closed = lambda a: f"list_transform([{two(a)}], lambda v: [{a}[1], {a}[2], v, {least(f'{a}[4]', inserted('v'))}])[1]"
    symbol, late = "x[1]['s']", "x[1]['c']"
    kept = lambda initial, w: f"case when {symbol} = '{initial}' then {by(w, 'K', late)} end"
    changed = lambda w: f"case when {symbol} <> 'x' then {by(w, 'R', f'{REROLE} + {late}')} end"
    gone = lambda k: by(f"b[{k}]", "D", str(DELETE))
    read = f"[{gone(1)}, {least(gone(2), kept('s', 'b[1]'))}, {least(gone(3), *(f(f'b[{k}]') for k in (1, 2, 4) for f in (lambda w: kept('u', w), changed)))}, {least(gone(4), kept('a', 'b[3]'), changed('b[3]'))}]"
    fold = f"list_reduce(list_prepend([{{'c': 0, 's': ''}}, null, null, null], rows), lambda a, x: list_transform([{closed('a')}], lambda b: {read})[1])"
    return rf"""with crcs as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
    own as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as b from conversations),
    kinds as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 20 as kind from own, crcs),
    damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) from kinds where kind <> 0),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, regexp_replace(text, '{space}+$', '') as body from damaged),
    judged as (select *, lag(left(role, 1)) over (partition by conv_id order by i) as before, case when body = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault from placed),
    lists as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
      count(*) filter (before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal, list([{{'c': case when fault = 3 then {TRUNCATED} else 0 end, 's': case when fault in (1, 2) then 'x' when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end}}] order by i) as rows from judged group by conv_id),
    folded as (select * exclude (rows, w), {closed("w")} as w from (select *, {fold} as w from lists)),
    best as (select * exclude (w), {least("w[1]", "w[4]")} as w from folded),
    edits as (select conv_id, e, row_number() over (partition by conv_id order by j) as j, count(*) filter (e <> 'I') over (partition by conv_id order by j) as i, count(*) filter (e <> 'D') over (partition by conv_id order by j) as k, count(*) filter (e <> 'D') over (partition by conv_id) as n
      from (select conv_id, unnest(string_split(w['s'], '')) as e, generate_subscripts(string_split(w['s'], ''), 1) as j from best where w['s'] <> '')),
    said as (select e.conv_id, sha256(string_agg(case when e = 'K' then role when (k + n) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by j)) as h
      from edits e left join placed p on e.conv_id is not distinct from p.conv_id and e.i = p.i and e.e <> 'I' where e <> 'D' group by e.conv_id)
    select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
      coalesce(w['c'], 0)::bigint as cost, coalesce(w['s'], '') as audit, coalesce(h, sha256('')) as repaired_sha256
    from (select distinct conv_id from conversations) a left join best b on a.conv_id is not distinct from b.conv_id left join said s on a.conv_id is not distinct from s.conv_id"""
