"""Importance resampling toward a target distribution, over hashed runs of words.

Two passes over the texts, both by Arrow batches. The first counts features by bucket: each
task adds up one vector of ``buckets`` numbers with np.bincount, and a tree of additions merges
the vectors, so that no node holds more than a few of them. The gains of the buckets, the log of
how much more frequent a bucket is in the target, are one array of that fixed size, which is broadcast. The
second pass gathers gains by bucket and sums them by document with a weighted bincount. Noise
from a hash of the id turns weights into Gumbel scores: the highest are a sample in proportion to weight.

The draw: a histogram of scores, whole numbers within a fixed range (some tens of thousands at any
size), gives the score from which documents can be drawn. Only these are sorted, by ranges of
(score, doc_id, place in the input): a range can be cut anywhere, also among equal rows, so a hot score, id or group of copies
spreads over tasks. Ranks are places within a range after the number of rows of the ranges before.

Nulls: a null text has no features (weight 0); a null doc_id counts as the empty string in the
hash and comes after all ids among ties. Empty texts are like null ones. Long texts are taken whole, in pieces that end
between words. Repeated rows are rows of their own and take ranks of their own. Without a target, gains
tell only how rare a bucket is; empty tables give an empty result. Columns besides ``keep`` are not read,
so their names do not matter; n_features, weight, score and rank replace kept columns of these names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialize

#: Lower-cases A-Z; what is in no word becomes a space: of UTF-8 bytes, words hold digits, small letters and all from 0x80.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 22


class _Buckets(dict):
    """Bucket by feature, remembered up to a bound."""

    def __init__(self, buckets: int, most: int = 1_000_000):
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by pieces of some megabytes that end between words."""
    text = text.translate(_WORD_BYTES)
    at = 0
    while len(text) - at > _PIECE:
        end = text.find(b" ", at + _PIECE)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split() if at else text.split()


def _features(text: bytes | None, ngrams: int) -> Iterator[list[bytes]]:
    """All runs of 1 to ``ngrams`` words, joined by one space."""
    before: list[bytes] = []
    for words in _words(text or b""):
        found = list(words)
        if ngrams > 1:
            both = before + words
            for n in range(2, ngrams + 1):
                first = max(0, len(before) - n + 1)
                found += [b" ".join(both[i : i + n]) for i in range(first, len(both) - n + 1)]
            before = both[-(ngrams - 1) :]
        yield found


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """Features by bucket over all rows of one text column: a vector for each task, merged by a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for found in _features(text.as_py(), ngrams):
                    if found:
                        total += np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    parts = max(2, vectors.getNumPartitions())
    return none.union(vectors).treeReduce(np.add, depth=max(2, math.ceil(math.log(parts, 64))))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed frequency in the target over that in the source), by bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.astype(float), target.astype(float), strict=True)], np.int64)


def noise(key: Column, seed: str) -> Column:
    """Standard Gumbel noise in thousandths, from the first 8 hex digits of a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gains: np.ndarray, ngrams: int, carried: list[str], text: str) -> DataFrame:
    """``carried`` columns as _k0, _k1, ... and _n_words, n_features, weight: the floored mean gain of a document's features."""
    keep = [f"_k{i}" for i in range(len(carried))]
    spark, buckets = docs.sparkSession, len(gains)
    shared = spark.sparkContext.broadcast(gains.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for batch in batches:
            n = batch.num_rows
            sums, n_words, n_features = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            held: list[int] = []
            rows: list[int] = []
            sizes: list[int] = []

            def add() -> None:
                nonlocal sums
                if held:
                    of = np.repeat(np.array(rows), np.array(sizes))
                    sums = sums + np.bincount(of, weights=shared.value[np.array(held)], minlength=n)
                held.clear(), rows.clear(), sizes.clear()

            for i, x in enumerate(batch.column(len(keep)).cast(pa.large_binary())):
                for found in _features(x.as_py(), ngrams):
                    held.extend(map(bucket.__getitem__, found))
                    rows.append(i)
                    sizes.append(len(found))
                    n_features[i] += len(found)
                    if len(held) > 1_000_000:
                        add()
                # Runs of n words: one less for each word more, where there are enough words.
                n_words[i] = n_features[i] if ngrams == 1 else sum(len(w) for w in _words(x.as_py() or b""))
            add()
            weight = sums.astype(np.int64) // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n_words), pa.array(n_features), pa.array(weight)], [*keep, "_n_words", "n_features", "weight"])

    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(carried, keep, strict=True)], F.col(text).alias("_text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    return source.mapInArrow(run, ", ".join([*kinds, "_n_words long", "n_features long", "weight long"]))


def resample(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id where not given), n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred are drawn, rounded down. ``target``: a table with a column ``text``.
    """
    own = ("n_features", "weight", "score", "rank")
    keep = [c for c in (keep or [doc_id]) if c not in own or c == doc_id]
    carried = keep if doc_id in keep else [*keep, doc_id]
    gains = bucket_gains(bucket_counts(docs.select(text), ngrams, buckets), bucket_counts(target.select("text"), ngrams, buckets))
    weighed = weigh(docs, gains, ngrams, carried, text)
    key = f"_k{carried.index(doc_id)}"
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col(key), seed)), "weights")
    fits = F.col("_n_words") >= least_words
    # Scores lie within a fixed range, whatever the size of the input: see above.
    counts = sorted(((r["score"], r["count"]) for r in scored.where(fits).groupBy("score").count().collect()), reverse=True)
    n_drawn, above, cut = sum(c for _, c in counts) * percent // 100, 0, None
    for score, count in counts:
        if above >= n_drawn:
            break
        above, cut = above + count, score
    out = [*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *own[:3]]
    if cut is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    can = fits & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc(), F.col("_place").asc()]
    ordered = scored.where(can).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # The high bits of the new number are the range, the low 33 the place in it.
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for p, n in sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((p, before))
        before += n
    spark = docs.sparkSession
    starts = spark.createDataFrame(starts, "_part long, _before long")  # one row for each range
    rank = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1
    drawn = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*out, F.when(rank <= n_drawn, rank).alias("rank"))
    return drawn.unionByName(scored.where(~can).select(*out, F.lit(None).cast("long").alias("rank")))


def oracle_sql() -> str:
    """The result of ``resample`` for documents and benchmark; checksums by a fold over the bytes of each distinct word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digit = lambda k: f"(strpos('0123456789ABCDEF', substr(h, {k}, 1)) - 1)"
    found = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""with crcs as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
    d as (select doc_id, coalesce({found}, []) as w from documents), b as (select coalesce({found}, []) as w from benchmark),
    vocabulary as (select w, hex(encode(w)) as h from (select unnest(w) as w from d union select unnest(w) from b)),
    bytes as (select w, list_transform(range(len(h) // 2), lambda i: 16 * {digit("2 * i + 1")} + {digit("2 * i + 2")}) as x from vocabulary),
    bucket as (select w, xor(list_reduce(list_prepend(4294967295, x), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 10000 as k from bytes, crcs),
    dw as (select doc_id, unnest(w) as w from d),
    s as (select k, count(*) as n from dw join bucket using (w) group by 1), t as (select k, count(*) as n from (select unnest(w) as w from b) join bucket using (w) group by 1),
    totals as (select coalesce((select sum(n) from s), 0)::double as s_all, coalesce((select sum(n) from t), 0)::double as t_all),
    gains as (select k, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (s_all + 10000) / ((s.n + 1)::double * (t_all + 10000))))::bigint as g from s left join t using (k), totals),
    weights as (select doc_id, sum(g)::bigint as g from dw join bucket using (w) join gains using (k) group by 1),
    scored as (select doc_id, len(w)::bigint as n_features, case when len(w) = 0 then 0 else floor(coalesce(g, 0)::double / len(w)) end::bigint as weight,
      floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::ubigint::double + 0.5) / 4294967296)))::bigint as noise from d left join weights using (doc_id)),
    ranked as (select doc_id, n_features, weight, weight + noise as score, n_features >= 20 as fits, row_number() over (partition by n_features >= 20 order by weight + noise desc, doc_id) as r, count(*) over (partition by n_features >= 20) as n from scored)
    select doc_id, n_features, weight, score, case when fits and r <= 10 * n // 100 then r end::bigint as rank from ranked"""
