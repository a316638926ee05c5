"""Line dedup: repeated passages of lines, removed after byte comparison.

Each line that is not blank is hashed, a rolling hash covers each such line and the one before
it, and a chunk of lines ends where the rolling hash is the lowest of two lines on both sides. So boundaries follow
the content, and a passage has the same chunks inside wherever it stands. Units are
  - every chunk of two lines or more,
  - every window of two lines that are not blank, with the blank lines between them,
  - every line of 50 words or more.
Chunks are the index: a window inside a chunk counts once for each different chunk and place in it
that it has, however many places the chunk has. A chunk that repeats goes as a whole; a
window is looked for on its own only if it is in two different chunks, twice in one, or
over a boundary, which is the case at the edges of a passage. Either way every repeated
window goes: its places are in different chunks, or all in the same place of one chunk, which then repeats.
Hashes of windows leave out blank lines between, those of chunks do not; bytes decide in the end.

A unit is removed wherever it repeats, in any document; its first place, by doc_id, then by a hash of the text and then
by position, keeps it, and so does a place in the same document that overlaps the first.
What goes is the union of the lines covered, so a passage of two lines or more goes
wherever its borders lie. The first place of a line always stays.

First only hashes of units are counted. Units whose hash repeats are then taken from their
documents and grouped by hash and by all their bytes. What is sent back to documents is the
repeated units with their bytes, which are compared once more with the lines they would
remove. Grouping combines before the shuffle, so a unit that half of all documents share
is one row from each task; the join back to its places is an inner join that adaptive
execution splits by place. The largest group collected is the units of one document.

All of it is DataFrame and SQL functions.

Nulls: a null text has no lines and stays null; a null doc_id comes before all others.
Rows with the same doc_id and text are one document that is there twice: both stay as
they are, less what other documents or its own lines repeat. Rows of one doc_id (or none) with different texts are
documents of their own, in the order of their hashes. Texts of any length are taken whole; the units of one text are one array. Empty texts stay. An empty
table gives an empty result. All columns of the input pass through ``dedup_lines``; ``text``
is replaced, and ``n_lines_removed`` is added or replaced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import SPACE_CHARS, let, materialize, words


def units(text: Column, place: Column, min_lines: int = 2, long_words: int = 50, reach: int = 2) -> Column:
    """The units that may be removed: struct(h, s, n, code, chunk): hash, first line, lines, what it counts as, and whether it is a chunk.

    A unit repeats if its hash has two codes. Windows inside a chunk have the chunk's hash and
    their place in it as code; all other units have their place in the corpus.
    A chunk ends where the rolling hash is lowest of ``reach`` lines on both sides: 2 * reach + 1 lines on average.
    """

    def split(lines: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.ltrim(F.get(lines, i), F.lit(SPACE_CHARS)) != "")
        return F.struct(lines.alias("lines"), F.transform(lines, lambda v: F.xxhash64(v)).alias("hashed"), full.alias("full"))

    def roll(x: Column) -> Column:
        rolled = F.transform(x["full"], lambda i, j: F.xxhash64(*[F.get(x["hashed"], F.get(x["full"], j - back)) for back in range(min_lines - 1, 0, -1)], F.get(x["hashed"], i)))
        return let(rolled, lambda r: F.struct(x["lines"].alias("lines"), x["hashed"].alias("hashed"), x["full"].alias("full"), r.alias("rolled"), chunk_ends(r).alias("ends")))

    def chunk_ends(rolled: Column) -> Column:
        def lowest(j: Column) -> Column:
            out = j <= F.size(rolled) - 1 - reach
            for step in range(1, reach + 1):
                out = out & (F.get(rolled, j) < F.get(rolled, j - step)) & (F.get(rolled, j) < F.get(rolled, j + step))
            return out

        return F.concat(F.filter(F.sequence(F.lit(reach), F.greatest(F.size(rolled) - 1 - reach, F.lit(reach))), lowest), F.array(F.size(rolled) - 1))

    def cut(x: Column) -> Column:
        lines, hashed, full, rolled, ends = x["lines"], x["hashed"], x["full"], x["rolled"], x["ends"]

        def unit(s: Column, n: Column, h: Column, code: Column, chunk: bool = False) -> Column:
            return F.struct(h.alias("h"), s.alias("s"), n.alias("n"), code.alias("code"), F.lit(chunk).alias("chunk"))

        def of_chunk(c: Column) -> Column:
            first, last, s, n, key = c["first"], c["last"], c["s"], c["n"], c["key"]
            size = last - first + 1
            # A chunk of as many lines as a window is hashed as one, for other chunks have it as a window.
            own = F.when(size >= min_lines, F.array(unit(s, n, F.when(size == min_lines, F.get(rolled, last)).otherwise(key), F.xxhash64(place, s), True))).otherwise(F.array())

            def window(end: Column, code) -> Column:
                begin = F.get(full, end - (min_lines - 1))
                return unit(begin, F.get(full, end) - begin + 1, F.get(rolled, end), code(begin))

            # Windows that end in this chunk: the first min_lines - 1 began in another.
            over = F.filter(F.sequence(first, first + (min_lines - 2)), lambda j: (j <= last) & (j >= min_lines - 1))
            inside = F.when(size > min_lines, F.sequence(first + (min_lines - 1), last)).otherwise(F.array())
            return F.concat(own, F.transform(over, lambda j: window(j, lambda begin: F.xxhash64(place, begin))), F.transform(inside, lambda j: window(j, lambda begin: F.xxhash64(key, j - first))))

        def measured(e: Column, k: Column) -> Column:
            first = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            return F.struct(first.alias("first"), e.alias("last"), F.get(full, first).alias("s"), (F.get(full, e) - F.get(full, first) + 1).alias("n"))

        chunks = F.transform(F.transform(ends, measured), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), c["s"].alias("s"), c["n"].alias("n"), F.xxhash64(F.slice(hashed, c["s"] + 1, c["n"])).alias("key")))
        long = F.filter(full, lambda i: (F.length(F.get(lines, i)) >= 2 * long_words - 1) & (F.size(words(F.get(lines, i))) >= long_words))
        return F.concat(F.flatten(F.transform(chunks, of_chunk)), F.transform(long, lambda i: unit(i, F.lit(1), F.xxhash64(F.get(hashed, i), F.lit(1)), F.xxhash64(place, i))))

    return let(let(let(F.split(text, "\n"), split), lambda x: F.when(F.size(x["full"]) > 0, roll(x))), lambda x: F.when(x.isNotNull(), cut(x)))


def bodies(text: Column, found: Column, min_lines: int = 2) -> Column:
    """``found`` with bytes: struct(h, body, s, n, again), sorted by h, body and s. ``again``: an equal unit comes before it in the text and ends before it."""
    own = let(F.split(text, "\n"), lambda lines: F.array_sort(F.transform(found, lambda c: F.struct(c["h"].alias("h"), F.array_join(F.slice(lines, c["s"] + 1, c["n"]), "\n").alias("body"), c["s"].alias("s"), c["n"].alias("n")))))

    def again(order: Column, c: Column, k: Column) -> Column:
        # Of equal windows, the one min_lines places before is the first that cannot overlap.
        out = F.lit(False)
        for step in range(1, min_lines + 1):
            out = out | let(F.get(order, k - step), lambda p: F.coalesce((p["h"] == c["h"]) & (p["body"] == c["body"]) & (p["s"] + p["n"] <= c["s"]), F.lit(False)))
        return out

    return let(own, lambda order: F.transform(order, lambda c, k: F.struct(c["h"].alias("h"), c["body"].alias("body"), c["s"].alias("s"), c["n"].alias("n"), again(order, c, k).alias("again"))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, long_words: int = 50) -> DataFrame:
    """``docs`` without the repeats of units, and ``n_lines_removed``."""
    lowest = F.lit(-(2**63)).cast("long")
    names = [c for c in docs.columns if c != "n_lines_removed"]
    # Columns go by number until the end, so that no name of theirs meets one of the steps below.
    columns = [f"x_{i}" for i in range(len(names))]
    docs = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, columns, strict=True)])
    id_col, text_col = columns[names.index(id_col)], columns[names.index(text_col)]
    own = docs.select(*columns, F.coalesce(F.col(id_col).cast("long"), lowest).alias("_id"), F.shiftrightunsigned(F.xxhash64(text_col), 2).alias("_th"))
    # Id and hash as one number, as numbers combine in place before the shuffle.
    rank = F.col("_id").cast("decimal(19,0)") * F.lit(Decimal(2**62)) + F.col("_th").cast("decimal(19,0)")

    # A text of one short line has no unit.
    places = own.where(F.contains(text_col, F.lit("\n")) | (F.length(text_col) >= 2 * long_words - 1)).select("_id", "_th", F.inline(units(F.col(text_col), F.xxhash64("_id", "_th"), min_lines, long_words)))
    likely = places.groupBy("h").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low < high").select("h")
    found = places.select("_id", "_th", "h", "s", "n").join(likely, "h").groupBy("_id", "_th").agg(F.collect_set(F.struct("h", "s", "n")).alias("_found")).withColumnsRenamed({"_id": "_fid", "_th": "_fth"})
    held = materialize(own.join(found, (F.col("_id") == F.col("_fid")) & (F.col("_th") == F.col("_fth")), "left").drop("_fid", "_fth"), "line-units")
    some = held.where("_found is not null")

    equal = some.select("_id", "_th", F.inline(bodies(F.col(text_col), F.col("_found"), min_lines)))
    repeated = equal.groupBy("h", "body").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "body", "first")
    again = equal.select("_id", "_th", rank.alias("_rank"), "h", "s", "n", "again", F.length("body").alias("size"))
    hits = again.join(repeated, "h").where((F.col("size") == F.length("body")) & (F.col("again") | (F.col("_rank") > F.col("first"))))
    removed = hits.groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "n", "body")).alias("_cut")).withColumnsRenamed({"_id": "_cid", "_th": "_cth"})
    joined = some.join(removed, (F.col("_id") == F.col("_cid")) & (F.col("_th") == F.col("_cth")), "left")

    def left(lines: Column) -> Column:
        same = F.filter("_cut", lambda c: F.array_join(F.slice(lines, c["s"] + 1, c["n"]), "\n") == c["body"])
        gone = F.flatten(F.transform(same, lambda c: F.sequence(c["s"], c["s"] + c["n"] - 1)))
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(places)).alias("n"))

    done = joined.withColumn("_left", F.when(F.col("_cut").isNotNull(), let(F.split(text_col, "\n"), left)))
    text = F.when(F.col("_cut").isNotNull(), F.col("_left.text")).otherwise(F.col(text_col))
    named = list(zip(names, columns, strict=True))
    changed = done.select(*[(text if x == text_col else F.col(x)).alias(c) for c, x in named], F.coalesce("_left.n", F.lit(0)).cast("long").alias("n_lines_removed"))
    return changed.unionByName(held.where("_found is null").select(*[F.col(x).alias(c) for c, x in named], F.lit(0).cast("long").alias("n_lines_removed")))
