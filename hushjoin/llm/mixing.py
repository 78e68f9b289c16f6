"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Weights are given for the levels of a tree (domain, language, source). A budget of tokens runs down the tree:
among siblings it is shared by weight, a sibling whose whole subtree cannot use its share takes what it can,
and the rest goes to its siblings; only what all siblings together cannot use goes back to the level above.
Each leaf then takes a prefix of its documents in a seeded order, epoch after epoch, until its quota is met.

Null keys are a value of their own ("~"). Null and empty texts have no tokens and are never selected. Weights that are not
given are the default weight. Equal ranks are ordered by document id. Repeated rows of one id follow each other in the
order, shorter ones first, and each counts: a quota may take some of them. Rows without an id are ordered by their text.
Texts of any length count whole. Columns beyond those needed may have any name. An empty table gives an empty result.
The values of the first level are few: they are compared in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushjoin.llm.common import Scratch, free_name, scratch_scope
from hushjoin.llm.quality_rules import words_of

NONE = "~"
DOCS_PER_SLICE = 4096


@dataclass(frozen=True)
class Mix:
    """weights: for each level, a weight (whole number) by value. budget_percent: of all tokens, epochs: at most so many passes over a leaf."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}})
    default_weight: int = 1
    budget_percent: int = 60
    epochs: int = 2
    seed: int = 17


def domain_of(source: Column, n: int = 4) -> Column:
    """The table names no domain: sources are dealt to n domains by checksum; a null source has domain ~."""
    return F.coalesce(F.concat(F.lit("d"), (F.crc32(source.cast("binary")) % n).cast("string")), F.lit(NONE))


def _weight(mix: Mix, level: str) -> Column:
    given = mix.weights.get(level) or {}
    out = F.lit(mix.default_weight)
    for value, w in given.items():
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast("decimal(20,0)")


def quotas(leaves: DataFrame, mix: Mix, budget: Column) -> DataFrame:
    """Quota of each leaf. leaves: the level columns and tokens (long). budget: a column of one value, the tokens wanted.

    At each level the siblings are sorted by capacity over weight. From the most limited on, a sibling whose
    capacity is at most its share of what is left is filled; the others share the rest by weight, in whole
    tokens that add up exactly. Capacities are those of whole subtrees, so nothing comes back later.
    """
    cap = (F.col("tokens") * F.lit(mix.epochs)).cast("decimal(38,0)")
    state = leaves.withColumn("__cap", cap)
    grown = None
    for depth, level in enumerate(mix.levels):
        parents = list(mix.levels[:depth])
        keys = [*parents, level]
        nodes = state.groupBy(*keys).agg(F.sum("__cap").alias("cap"))
        if grown is None:
            nodes = nodes.withColumn("b", budget.cast("decimal(38,0)"))
        else:
            nodes = nodes.join(grown, parents)
        nodes = nodes.withColumn("w", _weight(mix, level)).withColumn("need", F.col("cap").cast("double") / F.col("w").cast("double"))
        order = Window.partitionBy(*parents).orderBy("need", level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("left", F.greatest(F.col("b") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.lit(0)).cast("decimal(38,0)"))
        nodes = nodes.withColumn("wr", F.sum("w").over(onward))
        full = F.col("cap") * F.col("wr") <= F.col("left") * F.col("w")
        # once one sibling is not filled, none after it is
        nodes = nodes.withColumn("open", F.max(F.when(full, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        among = Window.partitionBy(*parents, "open").orderBy("need", level)
        nodes = nodes.withColumn("rest", F.first("left").over(among.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        nodes = nodes.withColumn("wa", F.first("wr").over(among.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        nodes = nodes.withColumn("cw", F.sum("w").over(among.rowsBetween(Window.unboundedPreceding, 0)))
        share = F.when(F.col("open") == 0, F.col("cap")).otherwise(_whole("rest", "cw", "wa") - _whole("rest", "cw - w", "wa"))
        grown = nodes.select(*keys, F.least(share, F.col("cap")).cast("decimal(38,0)").alias("b"))
    return state.join(grown, list(mix.levels)).withColumn("quota", F.col("b").cast("long")).drop("__cap", "b")


def _whole(a: str, b: str, c: str) -> Column:
    """Whole part of a * b / c on whole numbers."""
    return F.expr(f"cast((cast({a} as decimal(24,0)) * cast({b} as decimal(14,0))) div cast({c} as decimal(14,0)) as decimal(38,0))")


def select_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Selected documents: level columns, id, epoch (from 0), n_tokens, n_taken (what of it the quota takes), and the columns of keep.

    Needs the columns lang and source. Tokens are words. The seeded order of an epoch is that of the md5 of
    seed, epoch and id. A leaf is cut into slices of that order, about DOCS_PER_SLICE documents each; token sums
    of the slices give each slice its place, so no task has to order a whole leaf. keep must not name other result columns.
    """
    scratch = Scratch(docs.sparkSession)
    src = F.col("source").cast("string")
    kept = [F.col(c).alias(f"__keep_{n}") for n, c in enumerate(keep)]
    doc = docs.select(
        *kept,
        F.col(id_col).alias("__id"),
        F.when(F.col(id_col).isNull(), F.concat(F.lit("~"), F.md5(F.col(text_col).cast("binary")))).alias("__own"),
        domain_of(src).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(src, F.lit(NONE)).alias("source"),
        F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens"),
    ).filter("n_tokens > 0")
    doc = scratch.write(doc)
    levels = list(mix.levels)
    leaves = doc.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    budget = leaves.agg(F.expr(f"cast(cast(sum(tokens) as decimal(30,0)) * {mix.budget_percent} div 100 as long)")).first()[0] or 0  # one row
    plan = quotas(leaves, mix, F.lit(budget))
    plan = scratch.write(plan.withColumn("slices", F.ceil(F.col("docs") / DOCS_PER_SLICE)))
    epochs = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(mix.epochs - 1))))
    epochs = epochs.withColumn("__room", F.col("quota") - F.col("epoch") * F.col("tokens")).filter("__room > 0")
    epochs = epochs.select(*levels, "epoch", "slices", "__room")
    rank = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("__id").cast("string"), F.col("__own"))).cast("binary"))
    placed = doc.join(epochs, levels).withColumn("__rank", rank)
    place = F.floor(F.conv(F.substring("__rank", 1, 7), 16, 10).cast("long") * F.col("slices") / F.lit(1 << 28))
    placed = scratch.write(placed.withColumn("__slice", place))
    sums = placed.groupBy(*levels, "epoch", "__slice").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy(*levels, "epoch").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__from", F.coalesce(F.sum("t").over(run), F.lit(0))).drop("t")
    inner = Window.partitionBy(*levels, "epoch", "__slice").orderBy("__rank", "__id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(starts, [*levels, "epoch", "__slice"])
    out = out.withColumn("__at", F.col("__from") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    out = out.filter("__at < __room").withColumn("n_taken", F.least(F.col("n_tokens"), F.col("__room") - F.col("__at")))
    return out.select(F.col("__id").alias(id_col), *levels, "epoch", "n_tokens", "n_taken", *[F.col(f"__keep_{n}").alias(c) for n, c in enumerate(keep)])


def keep_mix(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of docs that at least one epoch selects, with their own columns; rows without an id and repeated rows too."""
    row = free_name(docs, "__row")
    # numbers of rows are only the same in every use once they are written
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()))
    with scratch_scope():
        picked = scratch.write(select_mix(marked, mix, keep=(row,)).select(row).distinct())
    return marked.join(picked.hint("merge"), row, "left_semi").select(*docs.columns)  # the same plan at every size


def _level_sql(depth: int, mix: Mix) -> str:
    """SQL of one level of the budget, as common table expressions n<depth> .. g<depth>."""
    level, parents, keys = mix.levels[depth], mix.levels[:depth], mix.levels[: depth + 1]
    given = " ".join(f"WHEN '{v}' THEN {w}" for v, w in (mix.weights.get(level) or {}).items())
    weight = f"CASE {level} {given} ELSE {mix.default_weight} END" if given else str(mix.default_weight)
    k, part = ", ".join(keys), f"PARTITION BY {', '.join(parents)}" if parents else ""
    among = "PARTITION BY " + ", ".join([*parents, "open"])
    source = f"JOIN g{depth - 1} USING ({', '.join(parents)})" if depth else "CROSS JOIN budget"
    return f"""
n{depth} AS (
  SELECT {k}, b, cap, ({weight})::HUGEINT AS w, cap::DOUBLE / ({weight}) AS need
  FROM (SELECT {k}, sum(tokens)::HUGEINT * {mix.epochs} AS cap FROM leaves GROUP BY {k}) {source}
), l{depth} AS (
  SELECT *, greatest(b - coalesce(sum(cap) OVER ({part} ORDER BY need, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS rem,
         (sum(w) OVER ({part} ORDER BY need, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS wr FROM n{depth}
), o{depth} AS (
  SELECT *, max(CASE WHEN cap * wr <= rem * w THEN 0 ELSE 1 END) OVER ({part} ORDER BY need, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM l{depth}
), q{depth} AS (
  SELECT *, first_value(rem) OVER ({among} ORDER BY need, {level}) AS rest, first_value(wr) OVER ({among} ORDER BY need, {level}) AS wa,
         (sum(w) OVER ({among} ORDER BY need, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::HUGEINT AS cw FROM o{depth}
), g{depth} AS (
  SELECT {k}, least(CASE WHEN open = 0 THEN cap ELSE rest * cw // wa - rest * (cw - w) // wa END, cap) AS b FROM q{depth}
)"""


def sql(mix: Mix = Mix()) -> str:
    """The same selection for DuckDB. It has no crc32: names are checked byte by byte with the table of the polynomial."""
    levels = ", ".join(mix.levels)
    return f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), names AS (
  SELECT source, list_transform(range(octet_length(encode(source))), lambda i: ('0x' || substr(hex(encode(source)), 2 * i::INTEGER + 1, 2))::BIGINT) AS bytes
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
), domains AS (
  SELECT source, 'd' || xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS domain FROM names, crc_table
), doc AS (
  SELECT doc_id, coalesce(domain, '~') AS domain, coalesce(lang, '~') AS lang, coalesce(source, '~') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents LEFT JOIN domains USING (source)
), d AS (
  SELECT * FROM doc WHERE n_tokens > 0
), leaves AS (
  SELECT {levels}, sum(n_tokens) AS tokens FROM d GROUP BY {levels}
), budget AS (
  SELECT sum(tokens)::HUGEINT * {mix.budget_percent} // 100 AS b FROM leaves
), {",".join(_level_sql(i, mix) for i in range(len(mix.levels)))}, e AS (
  SELECT {levels}, epoch::INTEGER AS epoch, g.b - epoch * tokens AS room
  FROM leaves JOIN g{len(mix.levels) - 1} g USING ({levels}), range({mix.epochs}) t(epoch)
), p AS (
  SELECT d.*, epoch, room, coalesce(sum(n_tokens) OVER (PARTITION BY {levels}, epoch ORDER BY md5('{mix.seed}:' || epoch || ':' || doc_id), doc_id, n_tokens
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN e USING ({levels}) WHERE room > 0
)
SELECT doc_id, {levels}, epoch, n_tokens, least(n_tokens, room - pos)::BIGINT AS n_taken FROM p WHERE pos < room
"""


SQL = sql()
