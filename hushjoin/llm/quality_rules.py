"""Host-level quality rules, in DataFrame functions only.

Each document gets rule figures in one pass over its text. Failures are counted by host (any column that
names where a document came from), each host's failure rate is shrunk towards all hosts with a beta prior
fitted by moments, and hosts whose shrunk rate is too high are rejected with all their documents.

Null and empty texts have no words and fail the base rules. A null host has no verdict of its own: only the
base rules decide. Repeated rows are counted each time. Texts of any length are read whole. An empty table gives an
empty result. quality_verdicts() ignores other columns; keep_quality() carries them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushjoin.llm.common import Scratch, free_name

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MAX_HOST_RATE = 0.8
MAX_BROADCAST_HOSTS = 100_000
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body over value, which is worked out once even where lambdas inside use it again and again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of three that come twice or more. Windows are sorted with their places; equal neighbours are repeats."""

    def count(n: Column, ranked: Column) -> Column:
        after = F.slice(ranked, 2, F.size(ranked))
        pairs = F.zip_with(ranked, after, lambda a, b: F.when(a["w"] == b["w"], F.array(a["at"], b["at"])))
        hits = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        # each hit adds the words that the hit before it has not covered
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            hits,
            start,
            lambda s, at: F.struct((s["n"] + F.least(F.lit(WINDOW), at - s["last"])).alias("n"), at.alias("last")),
            lambda s: s["n"],
        )

    def windows(ws: Column) -> Column:
        size = F.size(ws)
        shifted = F.arrays_zip(ws.alias("a"), F.slice(ws, 2, size).alias("b"), F.slice(ws, 3, size).alias("c"))
        numbered = F.transform(shifted, lambda z, i: F.struct(F.concat_ws(" ", z["a"], z["b"], z["c"]).alias("w"), i.alias("at")))
        return F.sort_array(F.slice(numbered, 1, size - (WINDOW - 1)))

    return _let(words, lambda ws: F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(_let(windows(ws), lambda ranked: count(F.size(ws), ranked))))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def figures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long."""
    plain = F.coalesce(text, F.lit(""))
    whole = F.char_length(plain)
    blanks = whole - F.char_length(F.translate(plain, BLANKS, ""))
    symbols = whole - F.char_length(F.translate(plain, SYMBOLS, ""))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            (whole - blanks).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            duplicate_lines(text).cast("long").alias("n_dup_lines"),
            repeated_words(ws).cast("long").alias("n_repeat_words"),
        )

    return _let(words_of(text), of)


def base_failed(fig: Column) -> Column:
    return (fig["n_words"] < MIN_WORDS) | (100 * fig["n_repeat_words"] > MAX_REPEAT_PERCENT * fig["n_words"])


def rejected_hosts(verdicts: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts whose shrunk failure rate is over max_rate: columns host, n, n_failed, rate.

    The beta prior has the mean and the variance of the hosts' own rates (moments, each host once); with no
    spread between hosts, or none beyond what the mean allows, it weighs as much as one document.
    """
    hosts = verdicts.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row
    m, v = m or 0.0, v or 0.0
    s = m * (1 - m) / v - 1 if v > 0 and m * (1 - m) > v else 1.0
    shrunk = hosts.withColumn("rate", (F.col("n_failed") + F.lit(m) * F.lit(s)) / (F.col("n") + F.lit(s)))
    return shrunk.filter(F.col("rate") > max_rate).select("host", "n", "n_failed", "rate")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """id, host, the five figures, base_failed and kept of every document."""
    scratch = Scratch(docs.sparkSession)
    fig = docs.select(F.col(id_col), F.col(host_col).alias("host"), figures(F.col(text_col)).alias("f"))
    digest = scratch.write(fig.select(id_col, "host", "f.*", base_failed(F.col("f")).alias("base_failed")))
    bad = scratch.write(rejected_hosts(digest, "host", "base_failed", max_rate).select("host", F.lit(True).alias("host_rejected")))
    if bad.count() <= MAX_BROADCAST_HOSTS:
        bad = F.broadcast(bad)  # larger tables of rejected hosts are joined by shuffle, which splits hot hosts
    out = digest.join(bad, "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_rejected").isNull()).drop("host_rejected")


def keep_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that the base rules and the host verdicts keep, with their own columns."""
    scratch, failed, host = Scratch(docs.sparkSession), free_name(docs, "__failed"), free_name(docs, "__host")
    marked = docs.withColumn(failed, base_failed(_let(figures(F.col(text_col)), lambda f: f)))
    # one pass over the texts: rows are written once, those that fail without their text
    marked = scratch.write(marked.withColumn(text_col, F.when(~F.col(failed), F.col(text_col))))
    bad = scratch.write(rejected_hosts(marked, host_col, failed, max_rate).select(F.col("host").alias(host)))
    n = bad.count()
    passed = marked.filter(~F.col(failed)).select(*docs.columns)
    if n == 0:
        return passed
    if n <= MAX_BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return passed.join(bad, F.col(host_col) == F.col(host), "left_anti")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), g3 AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM g
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g3) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), f AS (
  SELECT w.doc_id, w.host, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
), h AS (
  SELECT host, count(*) AS n, sum(base_failed::BIGINT) AS k FROM b WHERE host IS NOT NULL GROUP BY host
), m AS (
  SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h
), pr AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1.0 END AS s FROM m
), bad AS (
  SELECT host FROM h, pr WHERE (k + m * s) / (n + s) > 0.8
)
SELECT doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM bad))) AS kept
FROM b
"""
