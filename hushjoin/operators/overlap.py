"""Overlap of two token tables (RecordId, RuleId, Token): equi-join on rule and comparable token, then pair counts.

The blank token equals itself, so that records that are blank for the same rule match on it; include_blank=False
leaves blank tokens out, which also avoids the largest possible join key. Counts (summary, only_left, pairs_by_rule,
by_count) make no pairs: records with the same tokens form a class, and classes are counted. matches() joins classes in
blocks of records, so that it shuffles and joins blocks and not pairs; blocks of a large class are dealt to all tasks,
and pairs are made last. Only records with several tokens for one rule are paired with the other side row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushjoin.functions import crypto

NEEDED = {"RecordId", "RuleId", "Token"}

#: A class of more pairs is cut into blocks. A side has up to about SPREAD blocks of BLOCK[0] records or more, and then so many that none has
#: much more than BLOCK[1]. Pairs are listed by RUN right ids.
CLASS_PAIRS, BLOCK, SPREAD, RUN = 1 << 20, (512, 32768), 16, 256


@cache
def _salts(tasks: int) -> list[int]:
    """For each of so many tasks a number whose rows hash partitioning gives to it (Murmur3 of an int, seed 42)."""
    found: dict[int, int] = {}
    turned = lambda x, n: (x << n | x >> 32 - n) & 0xFFFFFFFF
    for s in count():
        h = turned(42 ^ turned(s * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        found.setdefault((h - (h >> 31 << 32)) % tasks, s)
        if len(found) == tasks:
            return [found[t] for t in range(tasks)]


def comparable(tokens: DataFrame, key: bytes | None, rules: list[str] | None, include_blank: bool) -> DataFrame:
    """RecordId, RuleId and the decrypted token. The rule filter comes first and reaches the scan."""
    rows = tokens.filter(F.col("RuleId").isin(*rules)) if rules is not None else tokens
    rows = rows.filter("Token is not null")
    token = F.col("Token")
    if key is not None:  # a generator, since filters and join conditions would otherwise repeat the decryption below
        token = F.explode_outer(F.array(crypto.decrypt(token, key)))
    rows = rows.select("RecordId", "RuleId", token.alias("token"))
    return rows if include_blank else rows.filter(F.col("token") != crypto.BLANK)


@dataclass
class Overlap:
    """Two token tables and the key of their encryption (None: tokens compare as they are)."""

    left: DataFrame
    right: DataFrame
    key: bytes | None = None
    left_name: str = "Dataset1"
    right_name: str = "Dataset2"
    include_blank: bool = True

    def __post_init__(self):
        for df, name in ((self.left, self.left_name), (self.right, self.right_name)):
            if not NEEDED <= set(df.columns):
                raise ValueError(f"{name} must have columns: {sorted(NEEDED)}. Got: {sorted(df.columns)}")

    @property
    def ids(self) -> tuple[str, str]:
        return f"{self.left_name}_RecordId", f"{self.right_name}_RecordId"

    def written(self, folder: str) -> Overlap:
        """The same overlap over tables with opened tokens, written once to two folders under `folder`, for several questions."""
        sides = []
        for name, side in (("left", self.left), ("right", self.right)):
            path, token = f"{folder.rstrip('/')}/{name}", F.col("Token")
            opened = side.select("RecordId", "RuleId", (token if self.key is None else crypto.decrypt(token, self.key)).alias("Token"))
            opened.write.mode("overwrite").parquet(path)
            sides.append(side.sparkSession.read.parquet(path))
        return Overlap(*sides, None, self.left_name, self.right_name, self.include_blank)

    def rule_matches(self, rules: list[str] | None = None) -> DataFrame:
        """Pair of ids, RuleId: one row for each pair of rows with equal rule and token."""
        a, b = self.ids
        left = comparable(self.left, self.key, rules, self.include_blank).withColumnRenamed("RecordId", a)
        right = comparable(self.right, self.key, rules, self.include_blank).withColumnRenamed("RecordId", b)
        return left.join(right, ["RuleId", "token"]).select(a, b, "RuleId")

    def pairs(self, rules: list[str] | None = None) -> DataFrame:
        """Pair of ids, rules (sorted distinct rule ids) and n (matching row pairs)."""
        return self.rule_matches(rules).groupBy(*self.ids).agg(F.sort_array(F.collect_set("RuleId")).alias("rules"), F.count("*").alias("n"))

    def matches(self, rules: list[str]) -> DataFrame:
        """Pairs of ids that match on every rule: as many row pairs as rules listed."""
        if not rules:
            raise ValueError("matching_rules cannot be empty")
        a, b = self.ids
        left, right = self._records(sorted(set(rules)))
        odd = self._odd_matches(left, right).groupBy(a, b).agg(F.count("*").alias("n")).filter(F.col("n") == len(rules))
        return self._class_pairs(*(side.select("RecordId", self._key(rules).alias("key")).filter("key is not null") for side in (left, right))).union(odd.select(a, b))

    def _class_pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of ids with equal key, of tables (RecordId, key).

        Block i of a class on the left and block j on the right meet in cell i, j. Each block is copied to the cells of its row or
        column, n1 * g2 + n2 * g1 ids for n1 * n2 pairs. A task gets neighbouring cells, of n1 / side and n2 / side ids, and lists
        pairs in runs of right ids, so that a written column has few values in a short order that repeats: files hold the ids once
        and little for each pair. Broadcast are the large classes alone, of at least 2 * sqrt(CLASS_PAIRS) records each.
        """
        a, b = self.ids
        spark = left.sparkSession
        side = math.isqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
        tasks, most = side * side, side * -(-SPREAD // side)
        sizes = left.select("key", F.lit(1).alias("side")).union(right.select("key", F.lit(2).alias("side"))).groupBy("key")
        sizes = sizes.agg(*[F.count_if(F.col("side") == n).alias(f"n{n}") for n in (1, 2)])
        blocks = [F.least(F.ceil(F.col(f"n{n}") / BLOCK[0]), F.lit(most)) * F.ceil(F.col(f"n{n}") / (BLOCK[1] * most)) for n in (1, 2)]
        large = F.broadcast(sizes.filter(F.col("n1").cast("double") * F.col("n2") > CLASS_PAIRS).select("key", blocks[0].alias("g1"), blocks[1].alias("g2")))
        # cells of a class in r1 * r2 tasks; the task comes from a number whose hash is that task's
        rows = [f"least(g{n}, {tasks} div least(g{m}, {side}))" for n, m in ((1, 2), (2, 1))]
        task = F.expr(f"pmod(pmod(xxhash64(key), {tasks}) + i * {rows[0]} div g1 * {rows[1]} + j * {rows[1]} div g2, {tasks})")
        salt = F.array(*map(F.lit, _salts(tasks)))[task.cast("int")].alias("salt")

        def cells(records: DataFrame, mine: str, other: str, at: str, across: str) -> DataFrame:
            dealt = records.join(large, "key", "left").select("RecordId", "key", *[F.coalesce(g, F.lit(1)).alias(g) for g in ("g1", "g2")])
            block = F.pmod(F.xxhash64("RecordId"), mine).alias(at)
            # arrays, since a list leaves out an id that is null
            held = dealt.groupBy("key", "g1", "g2", block).agg(F.flatten(F.collect_list(F.array("RecordId"))).alias("ids"))
            return held.withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

        lefts, rights = F.col("ids").alias("lefts"), F.col("ids").alias("rights")
        none = F.lit(None).cast(left.select(F.array("RecordId")).schema[0].dataType), F.lit(None).cast(right.select(F.array("RecordId")).schema[0].dataType)
        dealt = cells(left, "g1", "g2", "i", "j").select(salt, "key", "i", "j", lefts, none[1].alias("rights"))
        dealt = dealt.union(cells(right, "g2", "g1", "j", "i").select(salt, "key", "i", "j", none[0].alias("lefts"), rights))
        # tasks by number: what a cell costs is its pairs, which are not seen in its bytes
        met = dealt.repartition(tasks, "salt").groupBy("salt", "key", "i", "j")
        met = met.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("lefts", "rights")]).filter("lefts is not null and rights is not null")
        # pairs: a higher-order function is not compiled, so that a left id at a time reaches the compiled loop, which holds all rows that one row gives
        runs = met.select("lefts", F.explode(F.expr(f"transform(sequence(1, size(rights), {RUN}), k -> slice(rights, k, {RUN}))")).alias("run"))
        return runs.select(F.explode(F.transform("lefts", lambda x: x)).alias(a), "run").select(a, F.explode("run").alias(b))

    def at_least(self, k: int, rules: list[str] | None = None) -> DataFrame:
        """Pairs that match on k rules or more: ids, MatchingTokens (sorted, joined by |), TokenCount."""
        p = self.pairs(rules).filter(F.size("rules") >= k)
        return p.select(*self.ids, F.concat_ws("|", "rules").alias("MatchingTokens"), F.size("rules").alias("TokenCount"))

    def any_of(self, rules: list[str]) -> DataFrame:
        return self.at_least(1, rules)

    def tiered(self, tiers: list[list[str]]) -> DataFrame:
        """For each left id its best pairs: the first tier (all of its rules match) that gives any, as tier from 1."""
        a, _ = self.ids
        p = self.pairs(sorted({r for t in tiers for r in t}))
        tier = F.coalesce(*[F.when(F.forall(F.array(*map(F.lit, t)), lambda r: F.array_contains("rules", r)), F.lit(i)) for i, t in enumerate(tiers, 1)])
        ranked = p.withColumn("tier", tier).filter("tier is not null").withColumn("best", F.min("tier").over(Window.partitionBy(a)))
        return ranked.filter("tier = best").select(*self.ids, "tier")

    def _records(self, rules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """A row a record, left and right: RecordId, have (sorted rule ids and tokens) and once (no rule has two)."""
        out = []
        for side in (self.left, self.right):
            rows = comparable(side, self.key, rules, self.include_blank).filter("RuleId is not null and token is not null")
            got = rows.groupBy("RecordId").agg(F.sort_array(F.collect_list(F.struct("RuleId", "token"))).alias("have"))
            out.append(got.withColumn("once", F.size("have") == F.size(F.array_distinct("have.RuleId"))))
        return out[0], out[1]

    def _odd_matches(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The rows of rule_matches where either record has several tokens for one rule."""
        a, b = self.ids
        rows = lambda side, name: side.select(F.col("RecordId").alias(name), F.inline("have"))
        parts = ((left.filter(~F.col("once")), right), (left.filter("once"), right.filter(~F.col("once"))))
        first, second = (rows(l, a).join(rows(r, b), ["RuleId", "token"]).select(a, b, "RuleId") for l, r in parts)
        return first.union(second)

    @staticmethod
    def _key(rules: list[str]) -> Column:
        """What a record must share with another to match on every rule; null where no record of one token a rule can."""
        part = F.filter("have", lambda x: x["RuleId"].isin(*rules))
        return F.when(F.col("once") & (F.size(part) == len(rules)), part)

    def only_left(self, rules: list[str]) -> DataFrame:
        """Left records without a match on all rules."""
        if not rules:
            raise ValueError("matching_rules cannot be empty")
        a, b = self.ids
        left, right = self._records(sorted(set(rules)))
        keys = right.select(self._key(rules).alias("key")).distinct()
        hit = left.select("RecordId", self._key(rules).alias("key")).join(keys, "key", "left_semi").select("RecordId")
        odd = self._odd_matches(left, right).groupBy(a, b).agg(F.count("*").alias("n")).filter(F.col("n") == len(rules))
        hit = hit.union(odd.select(a)).distinct()
        return self.left.select("RecordId").distinct().join(hit, "RecordId", "left_anti")

    def pairs_by_rule(self) -> DataFrame:
        """RuleId and pairs: how many pairs of rows match on it."""
        sides = [comparable(t, self.key, None, self.include_blank).select("RuleId", "token", F.lit(n).alias("side")) for n, t in ((1, self.left), (2, self.right))]
        counts = sides[0].union(sides[1]).filter("RuleId is not null and token is not null").groupBy("RuleId", "token")
        counts = counts.agg((F.count_if(F.col("side") == 1) * F.count_if(F.col("side") == 2)).alias("n")).filter("n > 0")
        return counts.groupBy("RuleId").agg(F.sum("n").alias("pairs"))

    def by_count(self) -> DataFrame:
        """TokenCount and pairs: how many pairs of records match on exactly so many rules (one or more).

        Pairs that share a subset of their tokens are counted by subset, and inclusion-exclusion over the sizes of subsets gives
        those that share no more. A record with k tokens has 2^k - 1 subsets.
        """
        left, right = self._records()
        both = left.withColumn("side", F.lit(1)).union(right.withColumn("side", F.lit(2))).filter("once")
        counts = [F.count_if(F.col("side") == n).alias(f"n{n}") for n in (1, 2)]
        classes = both.groupBy("have").agg(*counts)
        masks = classes.select("have", "n1", "n2", F.explode(F.expr("sequence(1L, shiftleft(1L, size(have)) - 1)")).alias("mask"))
        part = F.expr("filter(have, (x, i) -> (shiftright(mask, i) & 1) = 1)")
        shared = masks.select(part.alias("part"), "n1", "n2").groupBy("part").agg((F.sum("n1") * F.sum("n2")).alias("n")).filter("n > 0")
        sizes = shared.groupBy(F.size("part").alias("k")).agg(F.sum("n").alias("n"))
        terms = sizes.select("k", "n", F.explode(F.sequence(F.lit(1), "k")).alias("TokenCount"))
        term = "n * (factorial(k) div factorial(TokenCount) div factorial(k - TokenCount)) * if((k - TokenCount) % 2 = 0, 1, -1)"
        odd = self._odd_matches(left, right).groupBy(*self.ids).agg(F.count_distinct("RuleId").cast("int").alias("TokenCount"))
        every = terms.select("TokenCount", F.expr(term).alias("n")).union(odd.select("TokenCount", F.lit(1).cast("long")))
        return every.groupBy("TokenCount").agg(F.sum("n").alias("pairs")).filter("pairs > 0")

    def summary(self, rule_sets: list[list[str]]) -> DataFrame:
        """A row a rule set: rules, totals, matching and unique records of both sides, overlap_percentage.

        One pass over both tables for all sets. A class is the records that have the same tokens for a set's rules; all of
        its records match if both sides have some.
        """
        if not rule_sets or not all(rule_sets):
            raise ValueError("matching_rules cannot be empty")
        a, b = self.ids
        left, right = self._records(sorted({r for s in rule_sets for r in s}))
        by_rule = self._odd_matches(left, right).groupBy(a, b, "RuleId").agg(F.count("*").alias("n"))
        counts = by_rule.groupBy(a, b).agg(*[F.coalesce(F.sum(F.when(F.col("RuleId").isin(*set(s)), F.col("n"))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(rule_sets)])
        sets = F.array(*[F.when(F.col(f"n{i}") == len(s), F.lit(i)) for i, s in enumerate(rule_sets)])
        ends = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("RecordId")) for n, c in ((1, a), (2, b))])
        found = counts.select(ends.alias("ends"), F.explode(F.array_compact(sets)).alias("set")).select("set", F.inline("ends"))
        found = found.distinct().withColumn("odd", F.lit(True))
        keys = F.array(*[F.struct(F.lit(i).alias("set"), self._key(s).alias("key")) for i, s in enumerate(rule_sets)])
        rows = left.withColumn("side", F.lit(1)).union(right.withColumn("side", F.lit(2))).select("side", "RecordId", F.inline(keys))
        rows = rows.join(found, ["set", "side", "RecordId"], "left")
        # records without an id are one record that is not counted
        known = lambda n: (F.col("side") == n) & F.col("RecordId").isNotNull()
        some = [F.count_if(F.col("side") == n).alias(f"s{n}") for n in (1, 2)]
        all_ = [F.count_if(known(n)).alias(f"c{n}") for n in (1, 2)]
        odd = [F.count_if(known(n) & F.col("odd").isNotNull()).alias(f"o{n}") for n in (1, 2)]
        classes = rows.groupBy("set", "key").agg(*some, *all_, *odd)
        met = F.col("key").isNotNull() & (F.col("s1") > 0) & (F.col("s2") > 0)
        found = classes.groupBy("set").agg(*[F.sum(F.when(met, F.col(f"c{n}")).otherwise(F.col(f"o{n}"))).alias(f"m{n}") for n in (1, 2)])
        both = self.left.select("RecordId", F.lit(1).alias("side")).union(self.right.select("RecordId", F.lit(2).alias("side"))).distinct()
        total = both.agg(F.count_if(F.col("side") == 1).alias("t1"), F.count_if(F.col("side") == 2).alias("t2"))
        names = total.select("t1", "t2", F.posexplode(F.array(*[F.lit(",".join(s)) for s in rule_sets])).alias("set", "rules"))
        m1, m2 = F.coalesce("m1", F.lit(0)), F.coalesce("m2", F.lit(0))
        small = F.least("t1", "t2")
        share = F.when(small > 0, F.least(m1, m2) / small * 100).otherwise(F.lit(0.0))
        return names.join(found, "set", "left").select(
            "rules", F.col("t1").alias("total_records_dataset1"), F.col("t2").alias("total_records_dataset2"),
            m1.alias("matching_records_dataset1"), m2.alias("matching_records_dataset2"),
            (F.col("t1") - m1).alias("unique_to_dataset1"), (F.col("t2") - m2).alias("unique_to_dataset2"), share.alias("overlap_percentage"),
        )


class OverlapAnalyzer:
    """Overlap analysis with an encryption key, as a report: a dict of figures and the matches as a DataFrame."""

    def __init__(self, encryption_key: str | bytes):
        self.key = crypto.key_bytes(encryption_key)

    @classmethod
    def from_exchange(cls, **inputs) -> OverlapAnalyzer:
        from hushjoin.sources import exchange

        return cls(exchange.transport_key(exchange.resolve(**inputs)))

    def analyze(self, left: DataFrame, right: DataFrame, rules: list[str], left_name: str = "Dataset1", right_name: str = "Dataset2") -> dict:
        return self.compare(left, right, [rules], left_name, right_name)[0]

    def compare(self, left: DataFrame, right: DataFrame, rule_sets: list[list[str]], left_name: str = "Dataset1", right_name: str = "Dataset2") -> list[dict]:
        over = Overlap(left, right, self.key, left_name, right_name)
        rows = {r["rules"]: r.asDict() for r in over.summary(rule_sets).collect()}  # a row a rule set
        return [rows[",".join(s)] | {"matches": over.matches(s), "dataset1_name": left_name, "dataset2_name": right_name, "matching_rules": s} for s in rule_sets]

    @staticmethod
    def summary_text(result: dict) -> str:
        lines = ["Dataset overlap"]
        for n in (1, 2):
            lines.append(f"{result[f'dataset{n}_name']}: {result[f'total_records_dataset{n}']:,} records, {result[f'matching_records_dataset{n}']:,} matching, {result[f'unique_to_dataset{n}']:,} unique")
        lines.append(f"Rules: {', '.join(result['matching_rules'])}. Overlap: {result['overlap_percentage']:.2f}%")
        return "\n".join(lines)


def look_back(matches: DataFrame, left: DataFrame, right: DataFrame, ids: tuple[str, str]) -> DataFrame:
    """Matches with the columns of their source rows, prefixed left_ and right_."""
    a, b = ids
    l = left.select(F.col("RecordId").alias(a), *[F.col(c).alias(f"left_{c}") for c in left.columns if c != "RecordId"])  # noqa: E741
    r = right.select(F.col("RecordId").alias(b), *[F.col(c).alias(f"right_{c}") for c in right.columns if c != "RecordId"])
    return matches.join(l, a).join(r, b)


def matches_by_count(pairs: DataFrame, count_col: str = "TokenCount") -> DataFrame:
    """How many pairs match on how many rules."""
    return pairs.groupBy(count_col).agg(F.count("*").alias("pairs"))


def match_rate(matches: DataFrame, records: DataFrame) -> DataFrame:
    """One row: matches, records, match_rate (percent; 0 without records)."""
    counts = matches.agg(F.count("*").alias("matches")).crossJoin(records.agg(F.count("*").alias("records")))  # one row each
    share = F.when(F.col("records") > 0, F.col("matches") / F.col("records") * 100).otherwise(F.lit(0.0))
    return counts.withColumn("match_rate", share)
