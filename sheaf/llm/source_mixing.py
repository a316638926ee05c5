"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of the cells are raked
until their sums over each of the three meet the targets: again and again each cell is
multiplied by target over sum, for source, language and topic in turn. A cell's ratio of
raked to own tokens, divided by the largest ratio, is the probability with which each of
its documents is kept, so no cell is asked for more than it holds and the kept tokens
have the target shares in expectation. A document is kept if a hash of its id, a number
from 0 to 1, is below that probability: the choice does not depend on partitions or retries.

Cells are far fewer than documents and are summed with aggregation that combines before
the shuffle. Up to ``most_cells`` cells are raked as one partition by window sums, which need no
exchange; more of them by grouped sums, pre-aggregated and joined back, with a table written
after each sweep, so that no task holds all cells or all of a group. Both give the same weights. The
probabilities join the documents as a table whose size Spark knows. ``marginal_error``
says how far the raked shares are from their targets; ``mix`` warns where that is over
``tolerance``, as where the targets contradict each other.

Targets: shares by name, or ``power``: shares of the corpus to a power below 1, which
lifts small groups. Targets for groups that the corpus lacks are left out and the rest
scaled to 1; groups without a named share have the target 0, and their documents are not kept. All of it is DataFrame and SQL functions.

Nulls: a null source, language or topic is a group of its own, named by the empty string;
null texts have no tokens. A document without tokens has weight in no cell and is not
kept. A null doc_id is hashed as the empty string. Repeated rows are kept or left
together. An empty table gives an empty result. All columns of the input pass through
``mix``; a column ``topic`` is raked as it is, and where there is none the form of a text (by its length and table marks)
stands in for it. Texts of any length are taken whole. ``topic`` (nulls named by the empty string), ``n_tokens``, ``p_keep`` and ``kept`` replace columns of these names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import materialize, words

OWN = ("topic", "n_tokens", "p_keep", "kept")
AXES = ("source", "lang", "topic")


@dataclass(frozen=True)
class Target:
    """Shares by name, or the corpus's own shares to ``power``."""

    power: float = 1.0
    shares: dict[str, float] = field(default_factory=dict)


DEFAULT = {"source": Target(0.7), "lang": Target(0.8), "topic": Target(0.9)}

#: Stands in for a topic where the table has none: the form of a text.
FORM_SQL = """case when length(text) - length(replace(text, '|', '')) >= 5 then 'table'
 when length(text) < 600 then 'brief' when length(text) < 3000 then 'article' else 'long' end"""


def form(text: str = "text") -> Column:
    return F.coalesce(F.expr(FORM_SQL.replace("text", f"`{text}`")), F.lit("brief"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 for each doc_id: the first 48 bits of an MD5."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(2**48))


def target_shares(cells: DataFrame, axis: str, target: Target) -> DataFrame:
    """The groups of an axis with their target shares ``_t_<axis>``, which sum to 1."""
    groups = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("_n"))
    if target.shares:
        share = F.coalesce(*[F.when(F.col(axis) == k, F.lit(float(v))) for k, v in target.shares.items()], F.lit(0.0))
    else:
        whole = groups.agg(F.sum("_n")).first()[0]
        share = F.pow(F.col("_n") / F.lit(whole), F.lit(target.power))
    groups = groups.select(axis, share.alias(f"_t_{axis}"))
    scale = groups.agg(F.sum(f"_t_{axis}")).first()[0]
    return groups.withColumn(f"_t_{axis}", F.col(f"_t_{axis}") / F.lit(scale or 1.0))


def _group_sum(out: DataFrame, axis: str, windows: bool) -> DataFrame:
    """Adds ``_sum``, the sum of ``w`` over the cell's group."""
    if windows:
        return out.withColumn("_sum", F.sum("w").over(Window.partitionBy(axis)))
    return out.join(out.groupBy(axis).agg(F.sum("w").alias("_sum")), axis)


def rake(cells: DataFrame, targets: dict[str, Target], sweeps: int = 12, most_cells: int = 200_000) -> DataFrame:
    """``cells`` (source, lang, topic, tokens), a written table, with raked ``w`` and ``p_keep``."""
    stat = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").cast("double").alias("tokens")).first()
    windows = stat["n"] <= most_cells
    out = cells.withColumn("tokens", F.col("tokens").cast("double")).withColumn("w", F.col("tokens"))
    for axis in AXES:
        out = out.join(target_shares(cells, axis, targets[axis]), axis)
    if windows:
        out = out.coalesce(1)
    for _ in range(sweeps):
        for axis in AXES:
            out = _group_sum(out, axis, windows)
            w = F.try_divide(F.col("w") * F.col(f"_t_{axis}") * F.lit(stat["tokens"]), F.col("_sum"))
            out = out.withColumn("w", F.coalesce(w, F.lit(0.0))).drop("_sum")
        if not windows:
            out = materialize(out, "mix-sweep")
    out = materialize(out.withColumn("_r", F.col("w") / F.col("tokens")), "mix-raked")
    top = out.agg(F.max("_r")).first()[0]
    return out.select(*AXES, "tokens", "w", (F.col("_r") / F.lit(top or 1.0)).alias("p_keep"))


def marginal_error(raked: DataFrame, targets: dict[str, Target]) -> DataFrame:
    """axis, name, share and target of every group after raking."""
    whole = raked.agg(F.sum("w")).first()[0] or 1.0
    out = None
    for axis in AXES:
        share = raked.groupBy(axis).agg((F.sum("w") / F.lit(whole)).alias("share"))
        each = share.join(target_shares(raked, axis, targets[axis]), axis).select(F.lit(axis).alias("axis"), F.col(axis).alias("name"), "share", F.col(f"_t_{axis}").alias("target"))
        out = each if out is None else out.unionByName(each)
    return out


def mix(docs: DataFrame, targets: dict[str, Target] | None = None, topic: Column | None = None, sweeps: int = 12, seed: str = "mix:", most_cells: int = 200_000, tolerance: float = 0.01) -> DataFrame:
    """``docs`` with topic, n_tokens, p_keep and kept."""
    targets = targets or DEFAULT
    names = [c for c in docs.columns if c not in OWN]
    # Columns go by number until the end, so that no name of theirs meets one of the steps below.
    numbered = [f"x_{i}" for i in range(len(names))]
    kept = [F.col(x).alias(c) for c, x in zip(names, numbered, strict=True)]
    if topic is None and "topic" in docs.columns:
        topic = docs["topic"]
    given = [F.col(f"`{c}`").alias(x) for c, x in zip(names, numbered, strict=True)]
    rows = docs.select(*given, F.col("doc_id").alias("_doc"), "source", "lang", (form() if topic is None else F.coalesce(topic.cast("string"), F.lit(""))).alias("topic"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    named = [F.coalesce(F.col(a).cast("string"), F.lit("")).alias(a) for a in AXES]
    cells = materialize(rows.select(*named, "n_tokens").where("n_tokens > 0").groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    weights = rake(cells, targets, sweeps, most_cells)
    off = marginal_error(weights, targets).agg(F.max(F.abs(F.col("share") - F.col("target")))).first()[0]
    if off is not None and off > tolerance:
        warnings.warn(f"a raked share is {off:.3f} from its target after {sweeps} sweeps", stacklevel=2)
    raked = weights.select(*[F.col(a).alias(f"_{a}") for a in AXES], "p_keep")
    on = [F.coalesce(rows[a].cast("string"), F.lit("")) == raked[f"_{a}"] for a in AXES]
    joined = rows.join(raked, on[0] & on[1] & on[2], "left")
    p = F.when(F.col("n_tokens") > 0, F.coalesce("p_keep", F.lit(0.0))).otherwise(0.0)
    out = joined.withColumn("p_keep", p).withColumn("kept", uniform(F.col("_doc"), seed) < F.col("p_keep"))
    return out.select(*kept, *OWN)


def oracle_sql(targets: dict[str, Target] = DEFAULT, sweeps: int = 12, seed: str = "mix:") -> str:
    """DuckDB SQL of ``mix`` over documents by powers of the corpus's shares: doc_id, source, lang, topic, n_tokens, p_keep (6 places), kept."""
    form_sql = FORM_SQL.replace("text", "coalesce(text, '')")
    ctes = [
        f"d as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, {form_sql} topic, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) n_tokens from documents)",
        "c0 as (select source, lang, topic, sum(n_tokens)::double tokens from d where n_tokens > 0 group by all)",
    ]
    at = "c0"
    for axis in AXES:
        ctes.append(f"t_{axis} as (select {axis}, pow(sum(tokens) / (select sum(tokens) from c0), {targets[axis].power}) s from c0 group by 1)")
    joins = " ".join(f"join (select {a}, s / (select sum(s) from t_{a}) t_{a} from t_{a}) x_{a} using ({a})" for a in AXES)
    ctes.append(f"w0 as (select source, lang, topic, tokens, tokens w, t_source, t_lang, t_topic, (select sum(tokens) from c0) n from {at} {joins})")
    k = 0
    for _ in range(sweeps):
        for axis in AXES:
            ctes.append(f"w{k + 1} as materialized (select * replace (w * t_{axis} * n / sum(w) over (partition by {axis}) as w) from w{k})")
            k += 1
    ctes.append(f"p as (select source, lang, topic, (w / tokens) / max(w / tokens) over () p from w{k})")
    u = f"('0x' || substr(md5('{seed}' || coalesce(doc_id::varchar, '')), 1, 12))::bigint / 281474976710656.0"
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, source, lang, topic, n_tokens::bigint n_tokens, round(coalesce(p, 0), 6) p_keep, {u} < coalesce(p, 0) kept from d left join p using (source, lang, topic)"
