"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule votes for good (+1), for bad (-1) or abstains (0) on a document. Documents with
the same votes are one pattern, so the table of pattern counts has at most 3^R rows however
many documents there are. Expectation-maximisation over those counts estimates, for each
rule, how often it votes for good on good and on bad documents, and for bad on either, and
the share of good documents; a document's posterior follows from its votes. A rule that
errs often so weighs little, where all-must-pass filtering would let it reject alone.

All of it is DataFrame and SQL functions. Counting is per document within its row; only
pattern counts are shuffled, after partial aggregation. EM runs as one expression over the
pattern table, and its 4R + 1 numbers come back to the driver as literals.

Nulls and empty texts have no words: every count is 0, ``base_failed`` is true, ``kept`` is
false and the posterior is given all the same. Repeated rows are judged alike and counted
as often as they occur. An empty table gives an empty result. Only the columns named are
read; others of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import SPACE_CHARS, let, materialize, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, else abstains."""

    name: str
    good: str
    bad: str


#: Over n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper, n_marks.
#: A rule for one kind of junk abstains on everything else: its silence is no sign of quality.
RULES = (
    Rule("symbols", "false", "100 * n_symbols > 10 * n_words"),
    Rule("upper_case", "false", "100 * n_upper > 30 * word_chars"),
    Rule("marks", "false", "100 * n_marks > 30 * n_words"),
    Rule("repeats", "false", "100 * n_repeat_words > 30 * n_words"),
    Rule("dup_lines", "false", "100 * n_dup_lines > 30 * n_lines"),
    Rule("vocabulary", "100 * n_distinct >= 40 * n_words", "100 * n_distinct < 15 * n_words"),
    Rule("word_length", "word_chars between 3.5 * n_words and 7.0 * n_words", "word_chars < 2.5 * n_words or word_chars > 8.0 * n_words"),
    Rule("prose", "100 * n_symbols <= 2 * n_words and 100 * n_upper <= 10 * word_chars and 100 * n_marks <= 10 * n_words and 100 * n_repeat_words <= 10 * n_words", "n_words = 0"),
)


def repeat_words(w: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more in ``w``."""
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    ordered = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("x"), i.alias("i"))))
    has = F.size(w) >= WINDOW + 1

    def covered(order: Column) -> Column:
        # Sorted with their places, equal windows are neighbours.

        def repeated(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(order, k - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(order, k + 1)["x"] == x["x"], F.lit(False))

        return let(F.array_sort(F.transform(F.filter(order, repeated), lambda x: x["i"])), spread)

    def spread(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    # Without equal hashes no two windows are equal, and nothing has to be sorted.
    some = F.size(F.array_distinct(hashed)) < F.size(w) - (WINDOW - 1)
    return F.when(has, F.when(some, let(ordered, covered)).otherwise(0)).otherwise(0).cast("long")


def _length(c: Column) -> Column:
    return F.length(c).cast("long")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every document, within its row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those of the other rules."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.select(id_col, "_t", words(F.col("_t")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(without(x, SPACE_CHARS)) > 0)
    t, size = F.col("_t"), F.size
    return base.withColumn("_l", lines).select(
        id_col,
        size("_w").cast("long").alias("n_words"),
        _length(without(t, SPACE_CHARS)).alias("word_chars"),
        (_length(t) - _length(without(t, SYMBOLS))).alias("n_symbols"),
        (size("_l") - size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        size("_l").cast("long").alias("n_lines"),
        size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        (_length(t) - _length(without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_upper"),
        (_length(t) - _length(without(t, "!|"))).alias("n_marks"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def votes(rules: Sequence[Rule]) -> Column:
    """The pattern of votes, an array of -1, 0 and 1."""
    return F.array(*[F.expr(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end") for r in rules])


@dataclass(frozen=True)
class Accuracies:
    """Share of good documents; for each rule, (votes good, votes bad) among good and among bad documents."""

    prior: float
    good: tuple[tuple[float, float], ...]
    bad: tuple[tuple[float, float], ...]


def em_sql(n_rules: int, rounds: int, start_prior: float, smooth: float) -> str:
    """Spark SQL of one expression over ``p``, the array of (v, n): the state after ``rounds`` rounds.

    The state holds the prior m and, for rule r, the chances of a vote for good and for bad
    among good documents (gp, gn) and among bad ones (bp, bn). Starts: votes for bad are
    rare on good documents, votes for good less common on bad ones.
    """

    def odds(state: str, side: str) -> str:
        """log of prior times likelihood of pattern x."""
        one = f"case element_at(x.v, r) when 1 then ln({state}.{side}p[r - 1]) when -1 then ln({state}.{side}n[r - 1]) else ln(greatest(1 - {state}.{side}p[r - 1] - {state}.{side}n[r - 1], 1e-9D)) end"
        prior = f"{state}.m" if side == "g" else f"(1 - {state}.m)"
        return f"aggregate(sequence(1, {n_rules}), ln({prior}), (a, r) -> a + {one})"

    post = f"1D / (1D + exp({odds('s', 'b')} - ({odds('s', 'g')})))"
    weighed = f"transform(p, x -> named_struct('v', x.v, 'g', x.n * {post}, 'n', x.n))"

    def total(what: str, when: str = "true") -> str:
        return f"aggregate(q, 0D, (a, x) -> a + if({when}, {what}, 0D))"

    def rate(what: str, vote: int) -> str:
        return f"transform(sequence(1, {n_rules}), r -> ({total(what, f'element_at(x.v, r) = {vote}')} + {smooth}D) / ({total(what)} + {3 * smooth}D))"

    g, b = "x.g", "(x.n - x.g)"
    update = f"element_at(transform(array({weighed}), q -> named_struct('m', ({total(g)} + 1D) / ({total('x.n')} + 2D), 'gp', {rate(g, 1)}, 'gn', {rate(g, -1)}, 'bp', {rate(b, 1)}, 'bn', {rate(b, -1)})), 1)"
    start = f"named_struct('m', {start_prior}D, 'gp', array_repeat(0.7D, {n_rules}), 'gn', array_repeat(0.02D, {n_rules}), 'bp', array_repeat(0.3D, {n_rules}), 'bn', array_repeat(0.3D, {n_rules}))"
    return f"aggregate(sequence(1, {rounds}), {start}, (s, _) -> {update})"


def learn(patterns: DataFrame, n_rules: int, rounds: int = 12, start_prior: float = 0.8, smooth: float = 1.0) -> Accuracies:
    """EM over ``patterns`` (v, n). One row for each pattern that occurs, 3^R at most, whatever the corpus."""
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("p"))
    s = one.select(F.expr(em_sql(n_rules, rounds, start_prior, smooth)).alias("s")).first()["s"]
    return Accuracies(s["m"], tuple(zip(s["gp"], s["gn"], strict=True)), tuple(zip(s["bp"], s["bn"], strict=True)))


def posterior(pattern: Column, found: Accuracies) -> Column:
    """Probability that a document with these votes is good."""
    from math import log

    def side(rates: tuple[tuple[float, float], ...], prior: float) -> Column:
        total = F.lit(log(max(prior, 1e-12)))
        for k, (p, n) in enumerate(rates):
            v = F.get(pattern, F.lit(k))
            total = total + F.when(v == 1, F.lit(log(p))).when(v == -1, F.lit(log(n))).otherwise(F.lit(log(max(1 - p - n, 1e-9))))
        return total

    return 1 / (1 + F.exp(side(found.bad, 1 - found.prior) - side(found.good, found.prior)))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed, votes, quality (the posterior) and kept of every document."""
    counted = materialize(features(docs, id_col, text_col).withColumn("votes", votes(rules)), "rule-features")
    patterns = counted.groupBy(F.col("votes").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = learn(patterns, len(rules), rounds)
    quality = posterior(F.col("votes"), found)
    return counted.withColumn("base_failed", base_failed()).withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
