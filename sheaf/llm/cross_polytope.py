"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three times: random signs, then the fast Hadamard transform) turns each
unit vector; its code is the signed axis nearest to it. Near vectors tend to share codes.
There are several tables, each with rotations of its own. Where one code would leave more
than ``even_rows`` vectors in an even bucket, a second code is concatenated: the nearest
signed axis of another rotation among its first 1, 2, 4 ... axes, as many as bring buckets
down to that size, so that the number of buckets grows with the vectors (to 16,384 a table;
beyond it buckets are dealt out, see below). A query looks into the buckets nearest to it
(multiprobe; over two codes by the sum of their squared distances) in every table, and all
candidates found are ranked by their exact inner products.

Vectors of different lengths are taken into account by one more coordinate, which makes
all candidates equally long (queries have 0 there), so that the largest inner product is
the smallest angle. The candidates of a band of lengths (a factor of 1.3; at most 8 bands,
the last one holds all that is shorter) are made as long as the longest of the band, which
has buckets of its own, and queries look into all bands. For a band of one length the
coordinate is 0.

How it runs. A count of the codes (bands x tables x codes rows) tells which buckets are large:
those are dealt out over several salts, so a task compares at most ``bucket_rows``
candidates with ``query_rows`` queries, however common a vector is. Vectors travel packed
by bucket, in 32 bits a component where the column has them. A task keeps each query's best k, ties by id; a second exchange by
query merges them. Nothing is broadcast. The number of probes is measured: up to 200
queries are compared with all vectors, the probe that reaches each of their true
neighbours is computed, and the fewest probes are taken whose recall, less two standard
errors, is 0.92. Queries that found fewer than k are answered again over all buckets of
one table, which is exact.

Nulls: vectors that are null or zero, hold nulls or non-finite components, or have
another dimension than most, and rows without an id take no part. Rows with the query's
own id are no candidates for it; an id is found once. Equal scores go to the smaller id.
An empty table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialize

PACKED = "bucket int, salt int, part int, query boolean, ids binary, vectors binary"
FOUND = "slot int, query_id long, ids binary, scores binary"
RESULT = "query_id long, rank int, vec_id long, score double"
TRUE = "slot int, places binary, ids binary, scores binary, probes binary"
#: Largest by smallest length of a band, and bands at most.
BAND, BANDS = 1.3, 8
#: Buckets of a table at most, unless one code has more.
CODES = 1 << 14


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, scaled to keep lengths."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(-1, n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, n)
        step *= 2
    return x / math.sqrt(n)


def last_axes(n: int, size: int, even_rows: int) -> int:
    """Axes of the second code: the fewest (0 or a power of 2) with which ``n`` vectors dealt evenly leave ``even_rows`` in a bucket."""
    last = 0
    while 2 * size * max(1, 2 * last) * even_rows < n:
        more = 2 * last or 1
        if more > size or 4 * size * more > CODES:
            break
        last = more
    return last


def axis_code(y: np.ndarray) -> np.ndarray:
    """2 * the axis nearest to each row, and 1 more for its negative side."""
    axis = np.abs(y).argmax(1)
    return 2 * axis + (y[np.arange(len(y)), axis] < 0)


def axis_costs(y: np.ndarray) -> np.ndarray:
    """How much farther than the nearest each signed axis lies, squared."""
    both = np.empty((len(y), 2 * y.shape[1]))
    both[:, 0::2], both[:, 1::2] = y, -y
    return (both.max(1)[:, None] - both) ** 2


class Hasher:
    """Buckets of vectors in every band of lengths and table. ``longest``: the largest length of each band, or 0 for bands of one length; ``top``: the largest of all; ``even_rows``: see ``last_axes``, of ``n`` vectors."""

    def __init__(self, dim: int, tables: int, longest: tuple[float, ...] = (0.0,), top: float = 0.0, n: int = 0, even_rows: int = 1, seed: int = 17):
        self.dim, self.tables, self.longest, self.top = dim, tables, np.array(longest), top
        self.size = 1 << max(1, (dim + bool(self.longest.any()) - 1).bit_length())
        self.last = last_axes(n, self.size, even_rows)
        self.codes = 2 * self.size * max(1, 2 * self.last)
        self.buckets = len(self.longest) * tables * self.codes
        self.signs, self.more = (np.random.default_rng(at).choice([-1.0, 1.0], (tables, 3, self.size)) for at in (seed, seed + 1))

    def _rotated(self, x: np.ndarray, lift: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For each table the rotated rows, and the first axes of the second rotation where there is a second code."""
        wide = np.zeros((len(x), self.size))
        wide[:, : self.dim] = x
        if lift is not None and self.longest.any():
            wide[:, self.dim] = lift

        def turn(signs: np.ndarray) -> np.ndarray:
            y = wide
            for s in signs:
                y = hadamard(y * s)
            return y

        for t in range(self.tables):
            yield turn(self.signs[t]), turn(self.more[t])[:, : self.last] if self.last else None

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band, and one code for each table, of each vector."""
        squares, out = (x**2).sum(1), np.empty((len(x), self.tables), np.int64)
        band = np.zeros(len(x), np.int64)
        if len(self.longest) > 1:
            band = np.clip(np.floor(np.log(self.top / np.sqrt(squares)) / math.log(BAND)), 0, len(self.longest) - 1).astype(np.int64)
        lift = np.sqrt(np.maximum(self.longest[band] ** 2 - squares, 0))
        for t, (y, z) in enumerate(self._rotated(x, lift)):
            out[:, t] = axis_code(y) if z is None else axis_code(y) + 2 * self.size * axis_code(z)
        return band, out

    def _costs(self, x: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray]]:
        """The costs of all codes, for some queries and one table at a time."""
        step = max(1, (1 << 21) // self.codes)
        for at in range(0, len(x), step):
            for t, (y, z) in enumerate(self._rotated(x[at : at + step])):
                cost = axis_costs(y)
                if z is not None:
                    cost = (axis_costs(z)[:, :, None] + cost[:, None, :]).reshape(len(y), -1)
                yield slice(at, at + step), t, cost

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """For each query and table the place of every code, nearest first."""
        out = np.empty((len(x), self.tables, self.codes), np.min_scalar_type(self.codes - 1))
        for own, t, cost in self._costs(x):
            np.put_along_axis(out[own, t], np.argsort(cost, 1, kind="stable"), np.arange(self.codes, dtype=out.dtype)[None, :], 1)
        return out

    def stored(self, x: np.ndarray) -> np.ndarray:
        """The buckets that hold each vector, one for each table."""
        band, codes = self.of(x)
        return (band[:, None] * self.tables + np.arange(self.tables)) * self.codes + codes

    def probed(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest buckets of each query in each band and table."""
        codes = np.empty((len(x), self.tables, count), np.int64)
        for own, t, cost in self._costs(x):
            codes[own, t] = np.argpartition(cost, count - 1, 1)[:, :count]
        first = np.arange(len(self.longest) * self.tables).reshape(1, -1, self.tables, 1) * self.codes
        return (first + codes[:, None]).reshape(len(x), -1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


def compare(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best among ``v``. Products select; those within rounding of the k-th are computed again one by one, alike for equal vectors."""
    for at in range(0, len(q), 256):
        rough = q[at : at + 256] @ v.T
        rough[qid[at : at + 256, None] == vid[None, :]] = -np.inf
        m = min(k, len(v))
        kth = np.partition(rough, len(v) - m, 1)[:, len(v) - m]
        slack = 1e-12 * (1 + np.abs(rough).max(1, where=np.isfinite(rough), initial=0))
        for i, row in enumerate(rough):
            c = np.flatnonzero((row >= kth[i] - slack[i]) & (row > -np.inf))
            if len(c):
                exact = (v[c] * q[at + i]).sum(1)
                order = best(vid[c], exact, k)
                yield int(qid[at + i]), vid[c[order]], exact[order]


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("vec")
    return batch.column("id").to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows (id, vec) that take part, and their dimension."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    dims = own.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return (own.where(F.size("vec") == dims["d"]), dims["d"]) if dims else (own, 0)


def _bands(index: DataFrame, norm, short: float, long: float) -> tuple[float, ...]:
    """The largest length in each band, 0 where all lengths are alike."""
    if short > 0.999 * long:
        return (0.0,)
    count = min(BANDS, int(math.log(long / short) / math.log(BAND)) + 1)
    own = F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor(F.log(F.lit(long) / norm) / math.log(BAND)))).alias("band")
    out = [0.0] * count
    for r in index.groupBy(own).agg(F.min(norm).alias("short"), F.max(norm).alias("long")).collect():
        out[int(r["band"])] = 0.0 if r["short"] > 0.999 * r["long"] else r["long"]
    return tuple(out)


def true_probes(index: DataFrame, queries: DataFrame, hasher: Hasher, k: int, most: int = 200) -> np.ndarray:
    """For up to ``most`` queries and each of their true k nearest: how many probes find it. The queries are those with the least hashes of id."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vec").collect()
    if not sample:
        return np.zeros((0, k), np.int64)
    qid, q = np.array([r["id"] for r in sample], np.int64), np.array([r["vec"] for r in sample], np.float64)
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def join(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        ids, scores, probes = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = best(ids, scores, len(ids))
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
        return ids[order], scores[order], probes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = hasher.ranks(q)
        found = [none] * len(q)
        for batch in batches:
            ids, x = _vectors(batch, hasher.dim)
            if not len(ids):
                continue
            scores = q @ x.T
            scores[qid[:, None] == ids[None, :]] = -np.inf
            kth = np.partition(scores, len(ids) - min(k, len(ids)), 1)[:, len(ids) - min(k, len(ids))]
            near = [np.flatnonzero((row >= (max(b, f[1][-1]) if len(f[1]) == k else b)) & (row > -np.inf)) for row, b, f in zip(scores, kth, found, strict=True)]
            use = np.unique(np.concatenate(near))
            codes = np.zeros((len(ids), hasher.tables), np.int64)
            if len(use):
                codes[use] = hasher.of(x[use])[1]
            for i, c in enumerate(near):
                if len(c):
                    probes = rank[i][np.arange(hasher.tables), codes[c]].min(1).astype(np.int64) + 1
                    found[i] = join([found[i], (ids[c].astype(np.int64), scores[i, c], probes)])
        for at in range(0, len(q), 25):
            own = range(at, min(at + 25, len(q)))
            data = [np.repeat(np.array(own, np.int64), [len(found[i][0]) for i in own])] + [np.concatenate([found[i][c] for i in own]) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([at // 25], pa.int32()), *(pa.array([d.tobytes()], pa.binary()) for d in data)], names=[f.split()[0] for f in TRUE.split(", ")])

    def merged(table: pa.Table) -> pa.Table:
        place, ids, scores, probes = (np.frombuffer(b"".join(table[c].to_pylist()), d) for c, d in (("places", np.int64), ("ids", np.int64), ("scores", np.float64), ("probes", np.int64)))
        out = [join([(ids[at], scores[at], probes[at])])[2].tobytes() for i in np.unique(place) for at in [np.flatnonzero(place == i)]]
        return pa.table({"probes": pa.array(out, pa.binary())})

    rows = index.mapInArrow(run, TRUE).groupBy("slot").applyInArrow(merged, "probes binary").collect()
    return np.array([v for r in rows if len(v := np.frombuffer(r["probes"], np.int64)) == k])


def probe_count(needed: np.ndarray, codes: int, recall: float = 0.92) -> int:
    """The fewest probes whose recall on the sampled queries, less two standard errors, is at least ``recall``."""
    if len(needed) < 2:
        return codes
    for count in range(1, codes):
        hit = (needed <= count).mean(1)
        if hit.mean() - 2 * hit.std(ddof=1) / math.sqrt(len(hit)) >= recall:
            return count
    return codes


def _search(index: DataFrame, queries: DataFrame, hasher: Hasher, probes: int, k: int, bucket_rows: int, query_rows: int, sent: str = "f8") -> DataFrame:
    """``sent``: the type in which components travel, that of the column."""
    dim = hasher.dim
    step = max(1, (1 << 21) // (len(hasher.longest) * hasher.tables * probes))

    def parts_of(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, vectors and buckets, of so many queries at a time as have about two million buckets."""
        for batch in batches:
            ids, x = _vectors(batch, dim)
            for at in range(0, len(ids), step if query else max(1, len(ids))):
                own = slice(at, at + step) if query else slice(None)
                yield ids[own], x[own], hasher.probed(x[own], probes) if query else hasher.stored(x)

    def count(queries_too: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(hasher.buckets, np.int64)
            for _, _, c in parts_of(batches, queries_too):
                total += np.bincount(c.ravel(), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

        return run

    def sizes(df: DataFrame, queries_too: bool, most: int) -> np.ndarray:
        """Into how many parts each bucket is dealt; the table has bands x tables x codes rows."""
        out = np.zeros(hasher.buckets, np.int64)
        counts = df.mapInArrow(count(queries_too), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        out[counts["bucket"].to_numpy()] = -(-counts["n"].to_numpy() // most)
        return out

    salts, parts = sizes(index, False, bucket_rows), sizes(queries, True, query_rows)

    def pack(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, bucket in parts_of(batches, query):
                row = np.repeat(np.arange(len(ids)), bucket.shape[1])
                bucket = bucket.ravel()
                mine, other = (parts, salts) if query else (salts, parts)
                use = other[bucket] > 0
                row, bucket = row[use], bucket[use]
                with np.errstate(over="ignore"):
                    mixed = ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                deal = (mixed.astype(np.int64)) % np.maximum(mine[bucket], 1)
                order = np.lexsort((row, deal, bucket))
                row, bucket, deal = row[order], bucket[order], deal[order]
                edge = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(deal) != 0)]) if len(row) else np.zeros(0, np.int64)
                out = []
                for a, b in zip(edge, np.r_[edge[1:], len(row)], strict=True):
                    own = row[a:b]
                    data = ids[own].astype(np.int64).tobytes(), x[own].astype(sent).tobytes()
                    for o in range(other[bucket[a]]):
                        salt, part = (o, deal[a]) if query else (deal[a], o)
                        out.append((int(bucket[a]), int(salt), int(part), query, *data))
                for at in range(0, len(out), 500):
                    cols = list(zip(*out[at : at + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])

        return run

    def bucket(table: pa.Table) -> pa.Table:
        side = {}
        for query in (True, False):
            rows = table.filter(pa.compute.equal(table["query"], query)).to_pylist()
            side[query] = [np.concatenate([np.zeros(0, d), *(np.frombuffer(r[c], d) for r in rows)]) for c, d in (("ids", np.int64), ("vectors", sent))]
        (qid, q), (vid, v) = side[True], side[False]
        found = list(compare(qid, q.reshape(-1, dim).astype(np.float64), vid, v.reshape(-1, dim).astype(np.float64), k)) if len(qid) and len(vid) else []
        return pa.table({"slot": pa.array([hash(f[0]) % slots for f in found], pa.int32()), "query_id": pa.array([f[0] for f in found], pa.int64()), "ids": pa.array([f[1].astype(np.int64).tobytes() for f in found], pa.binary()), "scores": pa.array([f[2].tobytes() for f in found], pa.binary())})

    slots = max(1, math.ceil(queries.count() / 1000))
    packed = index.mapInArrow(pack(False), PACKED).unionByName(queries.mapInArrow(pack(True), PACKED))
    return packed.groupBy("bucket", "salt", "part").applyInArrow(bucket, FOUND).groupBy("slot").applyInArrow(merge(k), RESULT)


def merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        """The best k of what a query's buckets found, each id once."""
        table = table.sort_by("query_id")
        qids = table["query_id"].to_numpy()
        ids, scores = table["ids"].to_pylist(), table["scores"].to_pylist()
        edge = np.r_[np.flatnonzero(np.r_[True, np.diff(qids) != 0]), len(qids)] if len(qids) else np.zeros(1, np.int64)
        out: list[list] = [[], [], [], []]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            i = np.frombuffer(b"".join(ids[a:b]), np.int64)
            s = np.frombuffer(b"".join(scores[a:b]), np.float64)
            order = best(i, s, len(i))
            i, s = i[order], s[order]
            once = np.sort(np.unique(i, return_index=True)[1])[:k]
            out[0] += [int(qids[a])] * len(once)
            out[1] += range(1, len(once) + 1)
            out[2] += i[once].tolist()
            out[3] += s[once].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "rank": pa.array(out[1], pa.int32()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 8, probes: int | None = None, bucket_rows: int = 20_000, query_rows: int = 20_000, even_rows: int = 4_000) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for the rows where ``is_query`` (a condition on id) holds."""
    index, dim = usable(vectors, id_col, vec_col)
    if not dim:
        return vectors.sparkSession.createDataFrame([], RESULT)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    stat = index.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min(norm).alias("short"), F.max(norm).alias("long")).first()
    hasher = Hasher(dim, tables, _bands(index, norm, stat["short"], stat["long"]), stat["long"], stat["n"], even_rows)
    sent = "f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "f8"
    queries = index.where(is_query)
    if not probes:
        probes = hasher.codes if stat["n"] <= 20 * k else probe_count(true_probes(index, queries, hasher, k), hasher.codes)
    found = materialize(_search(index, queries, hasher, probes, k, bucket_rows, query_rows, sent), "neighbours")
    full = min(k, stat["ids"] - 1)
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= full).select(F.col("query_id").alias("id"))
    few = materialize(queries.join(enough, "id", "left_anti"), "few-found")
    if full <= 0 or few.isEmpty():
        return found
    whole = Hasher(dim, 1)
    again = _search(index, few, whole, whole.codes, k, bucket_rows, query_rows, sent)
    return found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(again)
