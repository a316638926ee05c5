"""N-gram Jaccard self-join by parity sketches, and the components of its links.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Its sketch has one
word for each block of the hash space: the XOR of the shingles that fall there. A shingle
in one set and not in the other changes one word at most, so the number of words in which
two sketches differ (their Hamming distance, in words) is a lower bound of the symmetric
difference. Sets with a Jaccard similarity of 0.8 or more differ in at most a ninth of
both sizes together. Sets are put into bands of sizes; in each band the number of blocks
exceeds the largest difference allowed, so that a set knows how many of its words, t, any
set that links with it must share (pigeonhole): two at least. Of its words that others have, a set
leaves out the t - 1 that most others have: a linking pair still meets at the rarest word that they
share. So a word that countless texts share by a common passage makes no candidates
by itself. Sets of fewer than 24 shingles would have one shingle to a block: their words are the
smallest few of their shingles, of which two must agree, and the same holds. Sets that
still share a word are candidates, and candidates are verified on their whole sets.

Exact copies (equal sets) are one class from the start, told apart by two 64-bit hashes:
sets that agree in the first and not in the second get ids of their own. For the rest, verification goes
in two rounds, as only components are wanted. First each class is compared with one
pivot, that member of its groups which shares most of its words: of a family of edited copies
the least edited, with which all others that belong to it link. Links join components. Then,
of the groups that still hold several components, a class's own shingles are counted,
those that no other class in such groups has. What two classes have in common is at most
what is not their own, which with their sizes bounds the similarity; a class that no other
of its group can reach by this bound drops out. Pairs of different components
that are left are compared by bit sketches, to which each shingle adds one bit by XOR (a bit or
more for each shingle): their Hamming distance is a lower bound of the symmetric difference, too. What
it allows is verified. Copies edited beyond the limit are many in a large family, but make no pairs.

How it runs. Sketch words travel packed, sorted by key, to one of many ranges of the key
space; a task finds the keys that occur twice, and sends them on by class, where the largest are left out. A
word that a thousandth of all sets or more has, by a sample, counts as larger than any other and never
meets in one task: it is dealt out by class, and from there on its groups are rows for aggregation that combines before its exchange,
and for joins that adaptive execution can split. (The sample decides how work is dealt out, not what is found.) Groups that still
hold several components become rows, too. Texts move once, and of candidates their sets. No group
is collected into one row, no pairs are made within a component, and a group of more than
``block_rows`` classes is dealt out to many tasks, each for one pair of its parts.

Nulls: null or empty texts, and texts without words, have the empty set and link with
nothing, so they are components of their own. Texts of fewer than five words are one
shingle. Texts of any length are taken whole, one at a time where long. Repeated rows (same doc_id) come
out once for each row, with equal components; rows of one doc_id with different texts are
documents of their own. A null doc_id gets the smallest id of its component, or null. Ties between groups of
the same size go by key. An empty table gives an empty result. Only doc_id and text are read, so other
columns of any name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialize, release
from sheaf.llm.shingles import U, bounds, mix, pieces, set_ids, shingle_sets, spans

SMALL = 24
#: 64-bit words of the smallest bit sketch; a power of two, as larger ones are folded to it.
SKETCH = 64
#: Words of a sketch that are compared before the others.
FIRST = 8
#: A class in one band: its words to leave out, the band (that of small sets is -1), and the size of its set.
ENTRY = np.dtype([("cls", "<i8"), ("drop", "<i4"), ("band", "<i4"), ("n", "<i8")])
#: One of so many sets is looked at to find words that very many have; what this share of them has or more is dealt out by class.
SAMPLE, HOT = 64, 0.001
#: What counts as the size of a word that very many have: more than any other.
HUGE = 2**40


def pack(bucket: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its number, and its part of each array as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]).tolist()
    ends = [*edge[1:], len(bucket)]
    columns = [pa.array(bucket[edge].astype(np.int32)), *(pa.array([a[i:j].tobytes() for i, j in zip(edge, ends, strict=False)], pa.binary()) for a in arrays)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"c{k}" for k in range(len(arrays)))])


def unpack(table: pa.Table, *types: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table[f"c{k}"].to_pylist()), t) for k, t in enumerate(types)]


def packed_schema(count: int) -> str:
    return ", ".join(["bucket int", *(f"c{k} binary" for k in range(count))])


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH words or, for large sets, as many more as give each shingle a bit; each shingle flips one of their bits."""
    bits = 64 * SKETCH
    while bits < len(shingles):
        bits *= 2
    flips = np.bincount((mix(shingles ^ U(0xA0761D6478BD642F)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch as if made with so many words: its halves laid over each other."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


class Bands:
    """Bands of sizes l..r with r = 1.25 l; the number of blocks and the largest difference of each."""

    def __init__(self, most: int = 1 << 40):
        right, blocks, differ = [], [], []
        left = SMALL
        while left <= most:
            r = left * 5 // 4
            d = r // 4  # a ninth of r and 1.25 r together
            right.append(r)
            differ.append(d)
            blocks.append(math.ceil(1.1 * (d + 1)) + 4)
            left = r + 1
        self.right, self.blocks, self.differ = (np.array(x, np.int64) for x in (right, blocks, differ))

    def two(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of each size, and whether sets of this size also meet those of the band before."""
        band = np.searchsorted(self.right, n)
        return band, (band > 0) & (n <= self.right[np.maximum(band, 1) - 1] * 5 // 4)

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n shingles meets those that it may link with: its own, and that of smaller ones."""
        band, also = self.two(np.array([n]))
        return [int(band[0]) - 1, int(band[0])] if also[0] else [int(band[0])]


def signatures(flat: np.ndarray, start: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketch words of many sets as keys, for each key the place of its entry, and the entries (with places of sets for classes)."""
    n = np.diff(start)
    keys, entry, entries, count = [], [], [], 0

    def add(key: np.ndarray, owner: np.ndarray, sets: np.ndarray, drop: np.ndarray, band: np.ndarray) -> None:
        nonlocal count
        keys.append(key)
        entry.append(owner + count)
        e = np.zeros(len(sets), ENTRY)
        e["cls"], e["drop"], e["band"], e["n"] = sets, drop, band, n[sets]
        entries.append(e)
        count += len(sets)

    small = np.flatnonzero((n > 0) & (n < SMALL * 5 // 4))
    if len(small):
        # Of a linking pair's common shingles, the two with the smallest hashes are among the first of both.
        size = np.minimum(n[small], n[small] - (4 * n[small] + 4) // 5 + 2)
        add(mix(flat[spans(start[small], size)] ^ U(0x5851F42D4C957F2D)), np.repeat(np.arange(len(small)), size), small, np.ones(len(small), np.int32), np.full(len(small), -1, np.int32))
    large = np.flatnonzero(n >= SMALL)
    band, also = bands.two(n[large])
    for sets, b in ((large, band), (large[also], band[also] - 1)):
        if not len(sets):
            continue
        blocks, size = bands.blocks[b], n[sets]
        first, row = np.cumsum(blocks) - blocks, np.repeat(np.arange(len(sets)), size)
        s = flat[spans(start[sets], size)]
        # Blocks are equal ranges of the hash space, so ascending hashes fall into them in order.
        slot = first[row] + (((s >> U(32)) * blocks[row].astype(U)) >> U(32)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        word = np.zeros(int(blocks.sum()), U)
        word[slot[edge]] = np.bitwise_xor.reduceat(s, edge)
        used = np.zeros(len(word), bool)
        used[slot[edge]] = True
        filled = np.add.reduceat(used.astype(np.int64), first)
        # With so many empty blocks that two sets might agree in these alone, they are words too; two at least agree.
        lean = filled < bands.differ[b] + 2
        owner = np.repeat(np.arange(len(sets)), blocks)
        block = np.arange(len(word)) - first[owner]
        use = used | lean[owner]
        with np.errstate(over="ignore"):
            key = mix(word[use] + mix(block[use].astype(U) * U(0x9E3779B97F4A7C15) + (2 * b[owner[use]] + 1).astype(U)))
        add(key, owner[use], sets, np.where(lean, 1, filled - bands.differ[b] - 1), b)
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, ENTRY)
    return np.concatenate(keys), np.concatenate(entry), np.concatenate(entries)


def other_id(cls: np.ndarray, check: np.ndarray) -> np.ndarray:
    return mix(cls.view(U) ^ mix(check.view(U))).view(np.int64)


def renamed(cls: np.ndarray, check: np.ndarray, taken: dict[int, int]) -> np.ndarray:
    """Class ids; of those that different sets have (``taken``: whose check keeps the id) the others get another."""
    if not taken:
        return cls
    move = np.array([taken.get(c, h) != h for c, h in zip(cls.tolist(), check.tolist(), strict=True)], bool)
    return np.where(move, other_id(cls, check), cls)


def identify(flat: np.ndarray, start: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    cls, check = set_ids(flat, start)
    return cls >> np.int64(64 - bits), check


def sets_of(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, th (hash of the text, tells rows with one id apart), n_shingles, class, its check and the id to take if another set has the class, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                flat, start = shingle_sets(part.column("text"))
                cls, check = identify(flat, start, bits)
                n = np.diff(start)
                ids = [pa.array(x, mask=n == 0) for x in (cls, check, other_id(cls, check))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n), *ids], names=["doc_id", "th", "n_shingles", "cls", "check", "other"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return own.mapInArrow(run, "doc_id long, th long, n_shingles long, cls long, check long, other long")


def common_words(docs: DataFrame, bits: int) -> np.ndarray:
    """Keys that the share ``HOT`` of a sample of classes or more has: a hint for dealing out work, which changes no result. At most the words of a set over ``HOT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, counts, total = Bands(), set(), {}, 0
        for batch in batches:
            for part in pieces(batch):
                flat, start = shingle_sets(part.column("text"))
                cls = identify(flat, start, bits)[0]
                n = np.diff(start)
                for i in np.flatnonzero((n > 0) & (n < 100_000)).tolist():
                    if int(cls[i]) not in seen and len(seen) < 200_000:
                        seen.add(int(cls[i]))
                        keys = signatures(flat[start[i] : start[i + 1]], np.array([0, n[i]]), bands)[0]
                        total += 1
                        for k in keys.tolist():
                            counts[k] = counts.get(k, 0) + 1
                if len(counts) > 1_000_000:
                    counts = {k: c for k, c in counts.items() if c > 1}
                if len(counts) > 1_000_000:
                    counts = {}
        often = {k: c for k, c in counts.items() if c > 1 and c >= HOT * total / 4}
        yield pa.RecordBatch.from_arrays([pa.array([0, *np.array(list(often), U).view(np.int64).tolist()], pa.int64()), pa.array([total, *often.values()], pa.int64()), pa.array([True] + [False] * len(often))], names=["gid", "n", "whole"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "gid long, n long, whole boolean")
    sums = materialize(some.groupBy("whole", "gid").agg(F.sum("n").alias("n")), "common-words")
    total = sums.where("whole").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Of a small sample, what three sets share is no evidence.
    often = sums.where(~F.col("whole") & (F.col("n") >= max(20, HOT * total))).select("gid")
    return np.sort(np.array([r["gid"] for r in often.toLocalIterator()], np.int64).view(U))


def shared_words(docs: DataFrame, buckets: int, bits: int, taken: dict[int, int], common: np.ndarray, flush: int = 1_000_000) -> DataFrame:
    """Every key that two classes or more share, with those that have it, how many they are, and whether it is common: packed by class."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(), set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            shift = bounds(np.array([len(e) for _, _, e in held]))
            keys, entries = np.concatenate([k for k, _, _ in held]), np.concatenate([e for _, _, e in held])
            owner = np.concatenate([o + s for (_, o, _), s in zip(held, shift[:-1], strict=True)])
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            bucket = (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
            if len(common):
                # A common word's classes go to as many buckets as there are, by class.
                hot = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys
                bucket[hot] = buckets + entries["cls"][owner[hot]] % buckets
                order = np.argsort(bucket, kind="stable")
                keys, owner, bucket = keys[order], owner[order], bucket[order]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True):
                use, at = np.unique(owner[i:j], return_inverse=True)
                rows.append((int(bucket[i]), keys[i:j].tobytes(), at.astype("<u2" if len(use) <= 65536 else "<u4").tobytes(), entries[use].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "owners", "entries"])

        for batch in batches:
            for part in pieces(batch):
                flat, start = shingle_sets(part.column("text"))
                cls = renamed(*identify(flat, start, bits), taken)
                n = np.diff(start)
                new = np.zeros(len(n), bool)
                new[np.unique(cls, return_index=True)[1]] = True
                new &= (n > 0) & np.array([c not in seen for c in cls.tolist()], bool)
                seen.update(cls[new].tolist())
                if len(seen) > 200_000:
                    seen.clear()
                flat = flat[spans(start[:-1][new], n[new])]
                keys, owner, entries = signatures(flat, bounds(n[new]), bands)
                entries["cls"] = cls[new][entries["cls"]]
                held.append((keys, owner, entries))
                if sum(len(k) for k, _, _ in held) > flush:
                    yield packed()
                    held = []
        if sum(len(k) for k, _, _ in held):
            yield packed()

    def meet(table: pa.Table) -> pa.Table:
        entries = [np.frombuffer(e, ENTRY) for e in table["entries"].to_pylist()]
        shift = bounds(np.array([len(e) for e in entries]))
        owner = np.concatenate([np.frombuffer(o, "<u2" if len(e) <= 65536 else "<u4").astype(np.int64) + s for o, e, s in zip(table["owners"].to_pylist(), entries, shift[:-1], strict=True)])
        keys, entries = np.frombuffer(b"".join(table["keys"].to_pylist()), U), np.concatenate(entries)
        hot = table["bucket"][0].as_py() >= buckets
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        if not hot:
            same = np.r_[keys[1:] == keys[:-1], False]
            many = same | np.r_[False, same[:-1]]
            keys, owner = keys[many], owner[many]
        own = entries[owner]
        order = np.lexsort((own["cls"], keys))
        keys, own = keys[order], own[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (own["cls"][1:] != own["cls"][:-1])][: len(keys)]  # a class is there once from each task
        keys, own = keys[new], own[new]
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        size = np.diff(np.r_[edge, len(keys)])
        size = np.full(len(keys), HUGE) if hot else np.repeat(size, size)
        use = size > 1
        return pa.Table.from_batches([pack(own["cls"][use] % buckets, keys[use].view(np.int64), size[use], own[use])])

    sent = docs.select("text").mapInArrow(send, "bucket int, keys binary, owners binary, entries binary")
    return sent.groupBy("bucket").applyInArrow(meet, packed_schema(3))


def rarest(shared: DataFrame) -> DataFrame:
    """The groups (keys) of each class without the ``drop`` largest in its band, packed by class: c0 to c2 the groups, their classes and whether they are common; c3 to c5 the
    two largest that a class has left in its band, the class, and the share of its shingles that its groups are."""

    def run(table: pa.Table) -> pa.Table:
        gid, size, own = unpack(table, np.int64, np.int64, ENTRY)
        order = np.lexsort((gid, -size, own["band"], own["cls"]))
        gid, size, own = gid[order], size[order], own[order]
        new = np.r_[True, (own["cls"][1:] != own["cls"][:-1]) | (own["band"][1:] != own["band"][:-1])][: len(gid)]
        first = np.flatnonzero(new)
        place = np.arange(len(gid)) - np.repeat(first, np.diff(np.r_[first, len(gid)]))
        use = place >= own["drop"]
        gid, size, own, top = gid[use], size[use], own[use], (place < own["drop"] + 2)[use]
        cls, at, held = np.unique(own["cls"], return_inverse=True, return_counts=True)
        score = held[at] / own["n"]
        row = pa.RecordBatch.from_arrays([pa.array([table["bucket"][0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (gid, own["cls"], size == HUGE, gid[top], own["cls"][top], score[top]))], names=["bucket", *(f"c{k}" for k in range(6))])
        return pa.Table.from_batches([row])

    return materialize(shared.groupBy("bucket").applyInArrow(run, packed_schema(6)), "groups")


def pivots_of(groups: DataFrame) -> DataFrame:
    """Pairs (a, b): each class b with the pivot a of its largest groups, the member that shares most words for its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c, s in zip(*(batch.column(k).to_pylist() for k in ("c3", "c4", "c5")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, t)) for x, t in ((g, np.int64), (c, np.int64), (s, np.float64))], names=["gid", "cls", "score"])

    largest = materialize(groups.select("c3", "c4", "c5").mapInArrow(run, "gid long, cls long, score double"), "largest-groups")
    tops = largest.groupBy("gid").agg(F.max(F.struct("score", "cls")).alias("top"))
    best = largest.select("gid", "cls").join(tops, "gid").groupBy("cls").agg(F.max("top").alias("best"))
    return best.where("best.cls <> cls").select(F.col("best.cls").alias("a"), F.col("cls").alias("b"))


def grouped_classes(groups: DataFrame) -> DataFrame:
    """(cls) of every class that has a group left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column("c1").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(c, np.int64)))], names=["cls"])

    return groups.select("c1").mapInArrow(run, "cls long")


def mixed_groups(groups: DataFrame, comps: DataFrame, buckets: int) -> DataFrame:
    """(gid, cls, comp) of the groups that hold several components. Common ones are rows from the start, and found by aggregation that combines before its exchange."""

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([pack(np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3)])
        gid, cls, hot = unpack(left, np.int64, np.int64, bool)
        known, comp = right["cls"].to_numpy(), right["comp"].to_numpy()
        order = np.argsort(known)
        known, comp = known[order], comp[order]
        own = cls.copy()
        if len(known):
            at = np.minimum(np.searchsorted(known, cls), len(known) - 1)
            own = np.where(known[at] == cls, comp[at], cls)
        bucket = np.where(hot, -1, (((gid.view(U) >> U(32)) * U(buckets)) >> U(32)).astype(np.int64))
        return pa.Table.from_batches([pack(bucket, gid, cls, own)])

    def mixed(table: pa.Table) -> pa.Table:
        gid, cls, comp = unpack(table, np.int64, np.int64, np.int64)
        order = np.lexsort((comp, gid))
        gid, cls, comp = gid[order], cls[order], comp[order]
        first = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]][: len(gid)])
        last = np.r_[first[1:], len(gid)] - 1
        use = np.repeat(comp[first] != comp[last], last - first + 1)
        return pa.table({"gid": gid[use], "cls": cls[use], "comp": comp[use]})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["c0", "c1", "c2"]).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[f"c{k}"], np.int64)) for k in range(3)], names=["gid", "cls", "comp"])

    out = "gid long, cls long, comp long"
    dealt = comps.select("cls", "comp", F.pmod("cls", F.lit(buckets)).cast("int").alias("bucket"))
    named = materialize(groups.select("bucket", "c0", "c1", "c2").groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(attach, packed_schema(3)), "group-components")
    common = named.where("bucket < 0").mapInArrow(rows, out)
    several = common.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("gid").alias("g"))
    return named.where("bucket >= 0").groupBy("bucket").applyInArrow(mixed, out).unionByName(common.join(several, F.col("gid") == F.col("g")).select("gid", "cls", "comp"))


def candidate_sets(involved: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, set, sketch) of one document of each class in ``involved`` (cls); a class may come twice where a repeated row is its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for c in batch.column("cls").to_pylist():
                new.append(c not in seen)
                seen.add(c)
            batch = batch.filter(pa.array(new, pa.bool_()))
            if len(seen) > 200_000:
                seen.clear()
            for part in pieces(batch, 1_000_000) if batch.num_rows else ():
                flat, start = shingle_sets(part.column("text"))
                sets = [flat[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                packed = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (sets, map(bit_sketch, sets))]
                yield pa.RecordBatch.from_arrays([part.column("cls"), *packed], names=["cls", "set", "sketch"])

    wanted = classes.join(involved, "cls").select("cls", F.col("rep.doc_id").alias("rid"), F.col("rep.th").alias("rth"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("cls", "text")
    return texts.mapInArrow(run, "cls long, set binary, sketch binary")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (np.frombuffer(x, U) for pair in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True) for x in pair)
            keep = [links(x, next(sides)) for x in sides]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def own_shingles(sets: DataFrame, total: int, bucket_keys: int) -> DataFrame:
    """(cls, n_own): the shingles of each class that no other in ``sets`` has. Packed by ranges of the hashes, like the sketches."""
    buckets = max(1, math.ceil(total / bucket_keys))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = part.column("set").to_pylist()
                h = np.frombuffer(b"".join(packed), U)
                c = np.repeat(part.column("cls").to_numpy(zero_copy_only=False), [len(x) // 8 for x in packed])
                order = np.argsort(h)
                h, c = h[order], c[order]
                bucket = (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(h)])
                rows = [(int(bucket[i]), h[i:j].tobytes(), c[i:j].astype(np.int64).tobytes()) for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(h)], strict=False)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "classes"])

    def count(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table["keys"].to_pylist()), U)
        c = np.frombuffer(b"".join(table["classes"].to_pylist()), np.int64)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]  # classes that are there twice
        h, c = h[new], c[new]
        alone = np.r_[True, h[1:] != h[:-1]] & np.r_[h[1:] != h[:-1], True]
        cls, n = np.unique(c[alone], return_counts=True)
        slot = (cls.view(np.uint64) % U(buckets)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cls, n, slot = cls[order], n[order], slot[order]
        edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        ends = np.r_[edge[1:], len(slot)].astype(np.int64)
        rows = [(int(slot[i]), cls[i:j].tobytes(), n[i:j].astype(np.int64).tobytes()) for i, j in zip(edge, ends, strict=False)]
        return pa.table({"slot": pa.array([r[0] for r in rows], pa.int32()), "classes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def total_of(table: pa.Table) -> pa.Table:
        cls, at = np.unique(np.frombuffer(b"".join(table["classes"].to_pylist()), np.int64), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64), len(cls)).astype(np.int64)
        return pa.table({"cls": pa.array(cls), "n_own": pa.array(n)})

    sent = sets.select("cls", "set").mapInArrow(send, "bucket int, keys binary, classes binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "slot int, classes binary, counts binary")
    return counted.groupBy("slot").applyInArrow(total_of, "cls long, n_own long")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of every vertex of ``edges`` (a, b): each joins its smallest neighbour, and the graph shrinks until no edge is left."""
    labels = None
    edges = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    while not edges.isEmpty():
        step = materialize(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), "step")
        if labels is None:
            last, labels = None, step.select(F.col("v").alias("cls"), F.col("m").alias("comp"))
        else:
            last, labels = labels, labels.join(step, F.col("comp") == F.col("v"), "left").select("cls", F.coalesce("m", "comp").alias("comp"))
        labels = materialize(labels, "labels")
        ends = edges.join(step.select(F.col("v").alias("a"), F.col("m").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("m").alias("y")), "b")
        before, edges = edges, materialize(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        release(before, step, last)
    return labels if labels is not None else edges.select(F.col("a").alias("cls"), F.col("b").alias("comp"))


def near_in_group(cls: np.ndarray, comp: np.ndarray, n: np.ndarray, c: np.ndarray, sketch: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of different components that sizes, own shingles and sketches allow; of a group's two parts (``side`` 0 and 1), pairs across."""
    # 180 min(c) >= 80 (n + m): the other's size is at most ``top``. Who can have no partner by this goes, until all may have one.
    top = (9 * c) // 4 - n
    while True:
        use = np.zeros(len(n), bool)
        for s in np.unique(side):
            mine, others = side == s, side != s if side.any() else np.ones(len(n), bool)
            if others.any():
                use |= mine & (top >= n[others].min()) & (n <= top[others].max())
        if use.all():
            break
        cls, comp, n, c, sketch, side, top = (x[use] for x in (cls, comp, n, c, sketch, side, top))
        if len(n) < 2:
            return
    order = np.argsort(n, kind="stable")
    cls, comp, n, c, sketch, side, top = (x[order] for x in (cls, comp, n, c, sketch, side, top))
    low = np.searchsorted(n, (4 * n + 4) // 5)  # the smaller ones that sizes allow
    across = bool(side.any())
    for x in range(1, len(n)):
        i = low[x]
        y = (comp[i:x] != comp[x]) & (n[i:x] <= top[x]) & (n[x] <= top[i:x])
        if across:
            y &= side[i:x] != side[x]
        y = i + np.flatnonzero(y)
        for words in (slice(0, FIRST), slice(FIRST, None)):
            if len(y):
                apart = np.bitwise_count(sketch[y, words] ^ sketch[x, words]).sum(1, dtype=np.int64)
                y = y[9 * apart <= n[y] + n[x]]
        if len(y):
            apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(1, dtype=np.int64)
            for k in y[9 * apart <= n[y] + n[x]].tolist():
                yield min(int(cls[k]), int(cls[x])), max(int(cls[k]), int(cls[x]))


def cross_pairs(rows: DataFrame, classes: DataFrame, sets: DataFrame, bucket_keys: int, block_rows: int) -> DataFrame:
    """Pairs of different components that share one of the groups ``rows`` (gid, cls, comp) and whose sizes and own shingles allow a link."""
    involved = materialize(classes.join(rows.select("cls").distinct(), "cls").select("cls", F.col("n_shingles").alias("n")), "involved")
    total = involved.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = sets.join(involved.select("cls"), "cls", "left_semi")
    own = own_shingles(held, total, bucket_keys)
    # c: what a class can have in common with another at most. A link needs c >= 0.8 n.
    sized = involved.join(own, "cls", "left").select("cls", "n", (F.col("n") - F.coalesce("n_own", F.lit(0))).alias("c")).where("100 * c >= 80 * n")
    able = materialize(sized.join(sets.select("cls", "sketch").dropDuplicates(["cls"]), "cls"), "able")
    alive = materialize(rows.join(able.select(F.col("cls").alias("k")), F.col("cls") == F.col("k"), "left_semi"), "alive")
    sizes = alive.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").withColumn("cuts", F.ceil(F.col("m") / block_rows).cast("int"))
    # A group of more than block_rows is cut into parts by a hash; every pair of its parts is a block, compared by itself.
    own_cut = F.pmod(F.xxhash64("cls", "gid"), F.col("cuts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(o, own_cut).alias("i"), F.greatest(o, own_cut).alias("j")))
    dealt = alive.join(sizes.select("gid", "cuts"), "gid").select("gid", "cls", "comp", own_cut.alias("cut"), F.explode(others).alias("b"))
    # By the rows that are dealt, as many for each class as its group has cuts: a task gets about 20,000 of them, or one block.
    parts = max(1, math.ceil(sizes.agg(F.coalesce(F.sum(F.col("m") * F.col("cuts")), F.lit(0))).first()[0] / 20_000))
    spread = dealt.select("gid", "cls", "comp", "b.i", "b.j", "cut").withColumn("part", F.pmod(F.xxhash64("gid", "i", "j"), F.lit(parts)))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("gid", "ascending"), ("i", "ascending"), ("j", "ascending"), ("n", "ascending"), ("cls", "ascending")])
        gid, i, j, cut, cls, comp, n, c = (table[k].to_numpy() for k in ("gid", "i", "j", "cut", "cls", "comp", "n", "c"))
        packed = table["sketch"].to_pylist()
        edge = np.r_[np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]), len(gid)] if len(gid) else np.zeros(1, np.int64)
        found: set[tuple[int, int]] = set()
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if (comp[a:b] == comp[a]).all():
                continue
            words = min(map(len, packed[a:b])) // 8
            sketch = np.stack([fold(np.frombuffer(x, np.uint64), words) for x in packed[a:b]])
            side = (cut[a:b] != i[a]).astype(np.int8) if i[a] != j[a] else np.zeros(b - a, np.int8)
            if i[a] != j[a] and (side.all() or not side.any()):
                continue
            found.update(near_in_group(cls[a:b], comp[a:b], n[a:b], c[a:b], sketch, side))
        x, y = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    pairs = materialize(spread.join(able, "cls").groupBy("part").applyInArrow(meet, "a long, b long").distinct(), "cross-pairs")
    release(involved, able, alive)
    return pairs


def near_duplicates(docs: DataFrame, bucket_keys: int = 1_500_000, block_rows: int = 8192, class_bits: int = 64, detail: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; with ``detail`` also text_hash (xxhash64) and component,
    which tells apart components whose smallest doc_id is the same (null: a row of its own).

    ``bucket_keys``: keys that one task compares; ``block_rows``: classes of one group that one task compares with
    as many others; ``class_bits``: bits of class ids before those of different sets are told apart.
    """
    sets = materialize(sets_of(docs, class_bits), "sets")
    twice = sets.where("cls is not null").groupBy("cls").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
    # With 64 bits, by chance less than one class in a billion at 10 billion classes.
    taken = {r["cls"]: r["lo"] for r in twice.select("cls", "lo").toLocalIterator()}
    if taken:
        names = twice.select(F.col("cls").alias("k"), "lo")
        moved = F.when(F.col("lo").isNotNull() & (F.col("check") != F.col("lo")), F.col("other")).otherwise(F.col("cls"))
        sets = materialize(sets.join(names, F.col("cls") == F.col("k"), "left").select("doc_id", "th", "n_shingles", moved.alias("cls")), "sets")
    classes = materialize(sets.where("cls is not null").groupBy("cls").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least")), "classes")
    total = classes.agg(F.coalesce(F.sum(F.col("n_shingles") * 0.6 + 10), F.lit(0.0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_keys))
    groups = rarest(shared_words(docs, buckets, class_bits, taken, common_words(docs, class_bits)))
    candidates = materialize(candidate_sets(grouped_classes(groups), docs, classes), "candidate-sets")
    pairs = materialize(pivots_of(groups), "pivots")
    first = materialize(verify(pairs, candidates), "links")
    comps = components(first)
    mixed = materialize(mixed_groups(groups, comps, buckets), "mixed-groups")
    rest = cross_pairs(mixed, classes, candidates, bucket_keys, block_rows)
    if not rest.isEmpty():
        second = materialize(verify(rest, candidates), "links")
        if not second.isEmpty():
            comps = components(first.union(second))
        release(second)
    whole = classes.select("cls", "least").join(comps, "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
    least = whole.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = materialize(whole.select("cls", "comp").join(least, "comp").select(F.col("cls").alias("c"), "comp", "component_id"), "component-ids")
    release(groups, mixed, candidates, pairs, first, rest, comps, classes)
    out = sets.join(ids, F.col("cls") == F.col("c"), "left")
    more = [F.col("th").alias("text_hash"), F.col("comp").alias("component")] if detail else []
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)
