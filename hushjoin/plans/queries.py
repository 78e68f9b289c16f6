"""Registered linkage queries and their SQL. Both engines build the same persons from the keys of customer."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushjoin.functions import crypto, dates, validators
from hushjoin.functions.expressions import compile_expression
from hushjoin.operators import metadata, tokens
from hushjoin.operators.attributes import PLACEHOLDERS, SEX, TYPES, US_POSTAL_REJECTED, FieldRegistry, attribute_type
from hushjoin.operators.overlap import Overlap, OverlapAnalyzer, look_back, match_rate, matches_by_count
from hushjoin.operators.rules import DEFAULT, Part, Rule, RuleBuilder, RuleSet, quick_rules
from hushjoin.plans import oracle, people
from hushjoin.sources import config, exchange, files, generate
from hushjoin.sources.persons import canonical, read_persons
from hushjoin.streaming import tokens as streaming

SECRET = b"query-secret"
KEY = b"0123456789abcdef0123456789ABCDEF"
RING = "ring-1"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def persons(spark: SparkSession, sf_dir: str, prefix: str = "C", keys: str = "c_custkey", spread: bool = False) -> DataFrame:
    """spread: keys are dealt to all cores, since sealing costs far more than reading and a small file is read by one task."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    (rows.repartition(4 * spark.sparkContext.defaultParallelism) if spread else rows).createOrReplaceTempView("customer")
    return spark.sql(people.view(prefix, keys))


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_ONE = oracle.people_sql()
_BASE = _with(_ONE, oracle.signatures_sql())
_HMAC = oracle.token_sql(SECRET)
_TOKENS = _BASE + f"SELECT RecordId, RuleId, {_HMAC} AS Token FROM s"


# ---- attributes: normalized value where valid


def _attribute(name: str, column: str, short: str) -> None:
    def run(spark, sf_dir):
        p = persons(spark, sf_dir)
        value = p.select("RecordId", TYPES[name].value(F.col(column)).alias("value"))
        return value.select("RecordId", F.col("value").isNotNull().alias("valid"), "value")

    run.__name__ = f"attr_{short}"
    code = {"first_name": "fn", "last_name": "ln", "birth_date": "bd", "sex": "sx", "postal_code": "pc", "ssn": "sn"}[short]
    query(_with(_ONE) + f"SELECT RecordId, ok_{code} AS valid, CASE WHEN ok_{code} THEN {code} END AS value FROM n")(run)


for _n, _c, _s in (("FirstName", "FirstName", "first_name"), ("LastName", "LastName", "last_name"), ("BirthDate", "BirthDate", "birth_date"), ("Sex", "Sex", "sex"), ("PostalCode", "PostalCode", "postal_code"), ("SocialSecurityNumber", "SocialSecurityNumber", "ssn")):
    _attribute(_n, _c, _s)

#: Texts for the general types, by customer key.
_GENERAL = {
    "Integer": ["7", "+007", "-0", "-00450", " 12 ", "99999999999999999999999999", "1.5", "abc", "", None, "-٠١٢"],
    "Decimal": ["1", "+1.50", "-0.0", "1e10", "1.5e16", "12345678.9", ".5", "2.", "0.0001", "0.00001234", "1e400", "x", None, "9.9999999912345126e17", "٣.٥"],
    "Year": ["1999", " 2005 ", "0099", "12345", "19", None],
    "Age": ["0", "120", "121", "-1", " 42 ", "54.2", None],
    "BirthYear": ["1910", "1909", "2001", "2999", "abcd", None],
    "Date": ["2001-02-03", "2001/02/03", "02/03/2001", "02-03-2001", "03.02.2001", "2001-02-03T10:11:12Z", "2001-13-45", "2001-02-03T10:11:12", "20010203", None, "٢٠٠١-02-03"],
    "String": [" a b ", "x", "", "   ", None],
    "USPostalCode": ["951", "1234", "12346-7890", "987654321", "00012", " 54320 ", "ABC", None],
    "CanadianPostalCode": ["k1a0b1", "K1A 0A6", "J1X", "J1X1", "J1X1A", "m5v 2t6", "12345", None],
}
_EXPECTED = {
    "Integer": ["7", "7", "0", "-450", "12", "99999999999999999999999999", None, None, None, None, "-12"],
    "Decimal": ["1.0", "1.5", "-0.0", "10000000000.0", "1.5e+16", "12345678.9", "0.5", "2.0", "0.0001", "1.234e-05", "inf", None, None, "9.999999991234513e+17", "3.5"],
    "Year": ["1999", "2005", "99", None, None, None],
    "Age": ["0", "120", None, None, "42", None, None],
    "BirthYear": ["1910", None, "2001", None, None, None],
    "Date": ["2001-02-03", "2001-02-03", "2001-02-03", "2001-02-03", "2001-02-03", "2001-02-03", None, None, None, None, "2001-02-03"],
    "String": ["a b", "x", None, None, None],
    "USPostalCode": ["951", "1234", "12346", None, None, "54320", None, None],
    "CanadianPostalCode": ["K1A 0B1", None, "J1X", "J1X1", "J1X1A", "M5V 2T6", None, None],
}


def _general(name: str) -> None:
    pick = people._pick("c_custkey", _GENERAL[name])
    want = people._pick("c_custkey", _EXPECTED[name])
    fails = " OR ".join(f"c_custkey % {len(_GENERAL['Date'])} = {i}" for i in (6, 7)) if name == "Date" else "false"

    def run(spark, sf_dir):
        spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").createOrReplaceTempView("customer")
        kind, raw = TYPES[name], F.col("raw")
        rows = spark.sql(f"SELECT c_custkey, {pick} AS raw FROM customer")
        return rows.select("c_custkey", kind.value(raw).alias("value"), F.coalesce(kind.fails(raw), F.lit(False)).alias("fails"))

    run.__name__ = f"attr_{name.lower()}"
    query(f"SELECT c_custkey, {want} AS value, ({fails}) AS fails FROM customer")(run)


for _n in _GENERAL:
    _general(_n)


@query(
    """SELECT s_suppkey, trim(v) AS e_t, upper(v) AS e_u, trim(v)[1:3] AS e_s, v[1:length(v) - 2] AS e_s_neg, replace(v, 'pp', 'x') AS e_r,
    regexp_replace(v, '[^0-9]', '', 'g') AS e_m, upper(trim(v)[1:3]) AS e_chain
    FROM (SELECT s_suppkey, '  Supplier-' || CAST(s_suppkey AS STRING) || '-ab12 ' AS v FROM supplier)"""
)
def expressions(spark, sf_dir):
    """Each step of the expression language."""
    v = F.concat(F.lit("  Supplier-"), F.col("s_suppkey").cast("string"), F.lit("-ab12 "))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", v.alias("v"))
    steps = {"e_t": "T", "e_u": "U", "e_s": "T|S(0,3)", "e_s_neg": "S(0,-2)", "e_r": "R('pp','x')", "e_m": r"M(\d+)", "e_chain": "T|S(0,3)|U"}
    return rows.select("s_suppkey", *(compile_expression(e)(F.col("v")).alias(k) for k, e in steps.items()))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def expression_date(spark, sf_dir):
    """D on dates, written without leading zeros where they have any."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyy-M-d").alias("v"))
    return rows.select("o_orderkey", compile_expression("T|D")(F.col("v")).alias("d"))


# ---- rules and tokens


@query(_BASE + "SELECT RecordId, RuleId, Signature FROM s")
def signatures(spark, sf_dir):
    return tokens.signatures(persons(spark, sf_dir))


@query(_BASE + f"SELECT RecordId, RuleId, {oracle.token_sql(None)} AS Token FROM s WHERE RuleId = 'T3'")
def t3_sha256(spark, sf_dir):
    return tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.hash_only(), DEFAULT.only("T3"))


@query(_BASE + f"SELECT RecordId, RuleId, {oracle.token_sql(None)} AS Token FROM s")
def tokens_hash_only(spark, sf_dir):
    return tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.hash_only())


@query(_BASE + f"SELECT RecordId, RuleId, CASE WHEN coalesce(Signature, '') = '' THEN '{crypto.BLANK}' ELSE Signature END AS Token FROM s")
def tokens_plain(spark, sf_dir):
    return tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.plain())


@query(_TOKENS)
def tokens_hmac(spark, sf_dir):
    return tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.keyed(SECRET))


@query(_TOKENS)
def tokens_sealed(spark, sf_dir):
    """Keyed hash, AES and envelope, decrypted again. Blank tokens come back blank."""
    sealed = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.sealed(SECRET, KEY, RING))
    return sealed.select("RecordId", "RuleId", crypto.decrypt(F.col("Token"), KEY).alias("Token"))


@query(_TOKENS)
def tokens_aes(spark, sf_dir):
    """Bare AES, as helper generators make it, decrypted again."""
    sealed = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.sealed(SECRET, KEY, RING, envelope=False))
    return sealed.select("RecordId", "RuleId", crypto.decrypt(F.col("Token"), KEY).alias("Token"))


@query(_TOKENS)
def tokens_encrypt_decrypt(spark, sf_dir):
    """A keyed token table that is encrypted afterwards, where blank tokens stay, and decrypted again."""
    table = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.keyed(SECRET))
    return tokens.decrypt_tokens(tokens.encrypt_tokens(table, KEY, RING), KEY)


@query(_BASE + f"SELECT count(*) AS total, count(*) FILTER (Token <> '{crypto.BLANK}') AS transformed, 0::BIGINT AS failed FROM (SELECT {_HMAC} AS Token FROM s)")
def decrypt_summary(spark, sf_dir):
    table = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.keyed(SECRET))
    return tokens.transform_summary(tokens.encrypt_tokens(table, KEY, RING), KEY)


@query(_with(_ONE) + "SELECT sha256(RecordId) AS RecordId, Sex FROM p")
def record_id_hashes(spark, sf_dir):
    return tokens.record_id_hashes(persons(spark, sf_dir).select("RecordId", "Sex"))


@query(_with(_ONE, oracle.signatures_sql(rules={"T6": (("ln", "upper(ln)"), ("pc", "pc[1:3]"), ("sn", "replace(sn, '-', '')"))})) + "SELECT RecordId, RuleId, Signature FROM s")
def custom_rule_builder(spark, sf_dir):
    rule = RuleBuilder("T6").add("last_name", "T|U").add("postal_code", "T|S(0,3)").add("ssn", r"T|M(\d+)").build()
    return tokens.signatures(persons(spark, sf_dir), RuleSet().add(rule))


@query(_with(_ONE, oracle.signatures_sql(rules={"X1": (("fn", "upper(fn)"), ("sx", "sx[1:1]")), "X2": (("bd", "bd"), ("pc", "pc"))})) + "SELECT RecordId, RuleId, Signature FROM s")
def custom_rule_settings(spark, sf_dir):
    settings = config.parse(
        {
            "column_mappings": {
                "RecordId": {"column_name": "RecordId", "type": "RecordId"}, "Given": {"column_name": "FirstName", "type": "FirstName"},
                "Gender": {"column_name": "Sex", "type": "Gender"}, "Born": {"column_name": "BirthDate", "type": "BirthDate"}, "Zip": {"column_name": "PostalCode", "type": "PostalCode"},
            },
            "token_rules": {"X1": [{"field": "Given", "expression": "T|U"}, {"field": "Gender", "expression": "S(0,1)"}], "X2": [{"field": "Born", "expression": "D"}, {"field": "Zip", "expression": "T"}]},
        }
    )
    return tokens.signatures(canonical(persons(spark, sf_dir), settings.registry, settings.columns), settings.rules, settings.registry)


# ---- counts


@query(_with(_ONE, oracle.invalid_sql()) + "SELECT attribute, count(*) AS records FROM i GROUP BY attribute")
def invalid_by_type(spark, sf_dir):
    return metadata.invalid_by_type(persons(spark, sf_dir))


@query(_BASE + "SELECT RuleId, count(*) AS records FROM s WHERE coalesce(Signature, '') = '' GROUP BY RuleId")
def blank_by_rule(spark, sf_dir):
    return metadata.blank_by_rule(persons(spark, sf_dir))


@query(
    _with(_ONE, oracle.signatures_sql(), oracle.invalid_sql())
    + "SELECT (SELECT count(*) FROM p) AS total, "
    + ", ".join(f"(SELECT count(*) FROM i WHERE attribute = '{t}') AS invalid_{t}" for t in sorted(oracle.TYPES.values()))
    + ", "
    + ", ".join(f"(SELECT count(*) FROM s WHERE RuleId = '{r}' AND coalesce(Signature, '') = '') AS blank_{r}" for r in DEFAULT.ids)
)
def run_counters(spark, sf_dir):
    return metadata.counters(persons(spark, sf_dir))


@query(_with(_ONE) + "SELECT RecordId, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN NOT ok_{c} THEN '{t}' END" for c, t in oracle.TYPES.items()) + "], lambda x: x IS NOT NULL)), ',') AS invalid FROM n")
def invalid_attributes(spark, sf_dir):
    rows = tokens.invalid_attributes(persons(spark, sf_dir), list(oracle.TYPES.values()))
    return rows.withColumn("invalid", F.concat_ws(",", "invalid"))


@query(_BASE + "SELECT RuleId, count(*) AS tokens FROM s GROUP BY RuleId")
def tokens_by_rule(spark, sf_dir):
    return metadata.tokens_by_rule(tokens_hmac(spark, sf_dir))


@query(_BASE + "SELECT tokens, count(*) AS records FROM (SELECT RecordId, count(*) AS tokens FROM s GROUP BY RecordId) GROUP BY tokens")
def tokens_per_record(spark, sf_dir):
    return metadata.tokens_per_record(tokens_hmac(spark, sf_dir))


# ---- overlap of two tables over all keys, a third of which are the same persons under other ids; blank tokens are left out
# but in the counts named _with_blank: pairs of blank records are too many to list


def _overlap(spark, sf_dir, include_blank: bool = False) -> Overlap:
    pipe = tokens.Pipeline.keyed(SECRET)
    left = tokens.tokenize(persons(spark, sf_dir), pipe)
    right = tokens.tokenize(persons(spark, sf_dir, "D", people.OTHER_KEYS), pipe)
    return Overlap(left, right, None, "A", "B", include_blank)


def _sealed_overlap(spark, sf_dir, spread: bool = False) -> Overlap:
    """Both sides sealed under rings of their own, and opened in the join; blank equals blank."""
    left = tokens.tokenize(persons(spark, sf_dir, spread=spread), tokens.Pipeline.sealed(SECRET, KEY, "ring-a"))
    right = tokens.tokenize(persons(spark, sf_dir, "D", people.OTHER_KEYS, spread), tokens.Pipeline.sealed(SECRET, KEY, "ring-b"))
    return Overlap(left, right, KEY, "A", "B")


_TWO = _with(_ONE, oracle.signatures_sql(), oracle.people_sql("D", people.OTHER_KEYS, "2"), oracle.signatures_sql("2"), "m AS (SELECT s.RecordId AS A_RecordId, s2.RecordId AS B_RecordId, RuleId FROM s JOIN s2 USING (RuleId, Signature) WHERE Signature <> '')")
_PAIRS = "SELECT A_RecordId, B_RecordId, count(*) AS n, string_agg(RuleId, '|' ORDER BY RuleId) AS rules FROM m GROUP BY ALL"


@query(_TWO + "SELECT A_RecordId, B_RecordId FROM m WHERE RuleId IN ('T1', 'T2') GROUP BY ALL HAVING count(*) = 2")
def overlap_all_rules(spark, sf_dir):
    return _overlap(spark, sf_dir).matches(["T1", "T2"])


@query(_TWO + "SELECT A_RecordId, B_RecordId FROM m WHERE RuleId = 'T4' GROUP BY ALL")
def overlap_one_rule(spark, sf_dir):
    return _overlap(spark, sf_dir).matches(["T4"])


@query(_TWO + f"SELECT A_RecordId, B_RecordId, rules AS MatchingTokens, n::INTEGER AS TokenCount FROM ({_PAIRS}) WHERE n >= 3")
def overlap_k_of_n(spark, sf_dir):
    return _overlap(spark, sf_dir).at_least(3)


@query(_TWO + f"SELECT A_RecordId, B_RecordId, string_agg(RuleId, '|' ORDER BY RuleId) AS MatchingTokens, count(*)::INTEGER AS TokenCount FROM m WHERE RuleId IN ('T2', 'T4') GROUP BY ALL")
def overlap_any_rule(spark, sf_dir):
    return _overlap(spark, sf_dir).any_of(["T2", "T4"])


@query(_TWO + "SELECT DISTINCT RecordId FROM s WHERE RecordId NOT IN (SELECT A_RecordId FROM m WHERE RuleId IN ('T1', 'T3') GROUP BY A_RecordId, B_RecordId HAVING count(*) = 2)")
def overlap_only_left(spark, sf_dir):
    return _overlap(spark, sf_dir).only_left(["T1", "T3"])


@query(
    _TWO
    + """, t AS (SELECT A_RecordId, B_RecordId, CASE WHEN list_has_all(list(RuleId), ['T3', 'T4']) THEN 1 WHEN list_contains(list(RuleId), 'T2') THEN 2 WHEN list_contains(list(RuleId), 'T5') THEN 3 END AS tier
    FROM m GROUP BY ALL) SELECT A_RecordId, B_RecordId, tier FROM (SELECT *, min(tier) OVER (PARTITION BY A_RecordId) AS best FROM t WHERE tier IS NOT NULL) WHERE tier = best"""
)
def overlap_tiered(spark, sf_dir):
    return _overlap(spark, sf_dir).tiered([["T3", "T4"], ["T2"], ["T5"]])


_SETS = [["T1"], ["T1", "T2"], ["T3", "T4", "T5"]]


def _summary_sql() -> str:
    rows = []
    for s in _SETS:
        inside = "(" + ", ".join(f"'{r}'" for r in s) + ")"
        hit = f"(SELECT A_RecordId, B_RecordId FROM m WHERE RuleId IN {inside} GROUP BY ALL HAVING count(*) = {len(s)})"
        rows.append(
            f"SELECT '{','.join(s)}' AS rules, (SELECT count(DISTINCT RecordId) FROM s) AS t1, (SELECT count(DISTINCT RecordId) FROM s2) AS t2, "
            f"(SELECT count(DISTINCT A_RecordId) FROM {hit}) AS m1, (SELECT count(DISTINCT B_RecordId) FROM {hit}) AS m2"
        )
    return (
        "SELECT rules, t1 AS total_records_dataset1, t2 AS total_records_dataset2, m1 AS matching_records_dataset1, m2 AS matching_records_dataset2, t1 - m1 AS unique_to_dataset1, "
        f"t2 - m2 AS unique_to_dataset2, least(m1, m2) / least(t1, t2) * 100 AS overlap_percentage FROM ({' UNION ALL '.join(rows)})"
    )


@query(_TWO + _summary_sql())
def overlap_summary(spark, sf_dir):
    return _overlap(spark, sf_dir).summary(_SETS)


@query(_TWO + "SELECT RuleId, count(*) AS pairs FROM m GROUP BY RuleId")
def overlap_pairs_by_rule(spark, sf_dir):
    return _overlap(spark, sf_dir).pairs_by_rule()


@query(_TWO + f'SELECT n::INTEGER AS "TokenCount", count(*) AS pairs FROM ({_PAIRS}) GROUP BY n')
def overlap_matches_by_count(spark, sf_dir):
    """The same figures as overlap_by_count, from the listed pairs."""
    return matches_by_count(_overlap(spark, sf_dir).at_least(1))


@query(_TWO + f'SELECT n::INTEGER AS "TokenCount", count(*) AS pairs FROM ({_PAIRS}) GROUP BY n')
def overlap_by_count(spark, sf_dir):
    return _overlap(spark, sf_dir).by_count()


@query(_TWO + "SELECT A_RecordId, B_RecordId, p.LastName AS left_LastName, p2.LastName AS right_LastName FROM m JOIN p ON p.RecordId = A_RecordId JOIN p2 ON p2.RecordId = B_RecordId WHERE RuleId = 'T3'")
def overlap_look_back(spark, sf_dir):
    over = _overlap(spark, sf_dir)
    left = persons(spark, sf_dir).select("RecordId", "LastName")
    right = persons(spark, sf_dir, "D", people.OTHER_KEYS).select("RecordId", "LastName")
    return look_back(over.matches(["T3"]), left, right, over.ids)


_TWO_BLANK = _TWO.replace("JOIN s2 USING (RuleId, Signature) WHERE Signature <> ''", "JOIN s2 USING (RuleId) WHERE coalesce(s.Signature, '') = coalesce(s2.Signature, '')")


@query(_TWO_BLANK + _summary_sql())
def overlap_summary_with_blank(spark, sf_dir):
    return _overlap(spark, sf_dir, include_blank=True).summary(_SETS)


@query(_TWO_BLANK + "SELECT DISTINCT RecordId FROM s WHERE RecordId NOT IN (SELECT A_RecordId FROM m WHERE RuleId IN ('T1', 'T3') GROUP BY A_RecordId, B_RecordId HAVING count(*) = 2)")
def overlap_only_left_with_blank(spark, sf_dir):
    return _overlap(spark, sf_dir, include_blank=True).only_left(["T1", "T3"])


@query(_TWO_BLANK + "SELECT RuleId, count(*) AS pairs FROM m GROUP BY RuleId")
def overlap_pairs_by_rule_with_blank(spark, sf_dir):
    return _overlap(spark, sf_dir, include_blank=True).pairs_by_rule()


@query(_TWO_BLANK + f'SELECT n::INTEGER AS "TokenCount", count(*) AS pairs FROM ({_PAIRS}) GROUP BY n')
def overlap_by_count_with_blank(spark, sf_dir):
    return _overlap(spark, sf_dir, include_blank=True).by_count()


# ---- overlap as it is by default: both sides sealed, blank equals blank


@query(_TWO_BLANK + _summary_sql())
def overlap_sealed_summary(spark, sf_dir):
    return _sealed_overlap(spark, sf_dir).summary(_SETS)


@query(_TWO_BLANK + "SELECT DISTINCT RecordId FROM s WHERE RecordId NOT IN (SELECT A_RecordId FROM m WHERE RuleId IN ('T2', 'T4') GROUP BY A_RecordId, B_RecordId HAVING count(*) = 2)")
def overlap_sealed_only_left(spark, sf_dir):
    return _sealed_overlap(spark, sf_dir).only_left(["T2", "T4"])


@query(
    _TWO
    + "SELECT l.RecordId AS A_RecordId, r.RecordId AS B_RecordId FROM (SELECT RecordId, list(coalesce(Signature, '') ORDER BY RuleId) AS have FROM s GROUP BY RecordId) l "
    "JOIN (SELECT RecordId, list(coalesce(Signature, '') ORDER BY RuleId) AS have FROM s2 GROUP BY RecordId) r USING (have)"
)
def overlap_sealed_all_rules(spark, sf_dir):
    """Pairs that agree on every rule, records without any token among them."""
    return _sealed_overlap(spark, sf_dir, spread=True).matches(DEFAULT.ids)


@query(_TWO_BLANK + _summary_sql())
def overlap_by_exchange(spark, sf_dir):
    """Both parties take secret and key from one exchange document, each with its own private key."""
    (mine, mine_public), (theirs, theirs_public) = exchange.generate_key_pair("P-256"), exchange.generate_key_pair("P-256")
    document = exchange.build("query", mine_public, theirs_public)
    left = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.from_exchange("ring-a", value=document, private_key_value=mine))
    right = tokens.tokenize(persons(spark, sf_dir, "D", people.OTHER_KEYS), tokens.Pipeline.from_exchange("ring-b", value=document, private_key_value=theirs))
    return Overlap(left, right, OverlapAnalyzer.from_exchange(value=document, private_key_value=theirs).key, "A", "B").summary(_SETS)


def _without_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("Token", F.when(F.col("RuleId") != "T5", F.col("Token")))


@query(_TWO_BLANK + "SELECT RuleId, count(*) AS pairs FROM m WHERE RuleId <> 'T5' GROUP BY RuleId")
def overlap_null_tokens(spark, sf_dir):
    """Null tokens, here all those of T5, match nothing, not even where blank equals blank."""
    over = _overlap(spark, sf_dir, include_blank=True)
    return Overlap(_without_tokens(over.left), _without_tokens(over.right), None, "A", "B").pairs_by_rule()


@query(_TWO + "SELECT matches, records, matches / records * 100 AS match_rate FROM (SELECT (SELECT count(*) FROM m WHERE RuleId = 'T3') AS matches, (SELECT count(*) FROM p) AS records)")
def overlap_match_rate(spark, sf_dir):
    return match_rate(_overlap(spark, sf_dir).matches(["T3"]), persons(spark, sf_dir))


# ---- states, pipelines and files


@query(
    _with(_ONE)
    + f"""SELECT n.RecordId, 'D1' AS RuleId, CASE WHEN ok_ln AND shaped THEN concat_ws('|', upper(ln), bd) END AS Signature
    FROM n JOIN (SELECT RecordId, d0, coalesce(regexp_matches(BirthDate, '{dates.SHAPE}'), false) AS shaped FROM e) USING (RecordId) WHERE NOT (ok_ln AND shaped AND d0 IS NULL)"""
)
def signatures_unreadable_date(spark, sf_dir):
    """The third state of a rule: a date of the right form that is no day gives no row, one of no form a blank one."""
    registry = FieldRegistry.defaults().register("BirthDate", "Date")
    return tokens.signatures(persons(spark, sf_dir), RuleSet().add(Rule("D1", (Part("LastName", "T|U"), Part("BirthDate", "T")))), registry)


@query(_BASE + f"SELECT RecordId, RuleId, CASE WHEN coalesce(Signature, '') = '' THEN '{crypto.BLANK}' ELSE Signature END AS Token FROM s")
def tokens_encrypted_only(spark, sf_dir):
    """Encryption without a hashing secret: the signature itself is sealed."""
    sealed = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.sealed(None, KEY, RING))
    return sealed.select("RecordId", "RuleId", crypto.decrypt(F.col("Token"), KEY).alias("Token"))


@query(_TOKENS)
def tokens_strict_decrypt(spark, sf_dir):
    table = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.keyed(SECRET))
    return tokens.decrypt_tokens(tokens.encrypt_tokens(table, KEY, RING), KEY, strict=True)


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="hushjoin-")


def _written(spark, name: str) -> str:
    """A path in the shared folder; a local session without one has a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_dir()
    return f"{root.rstrip('/')}/hushjoin-written/{name}"


def _round_trip(kind: str) -> None:
    def run(spark, sf_dir):
        path = _written(spark, f"tokens.{kind}")
        files.write_tokens(tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.plain()), path)
        return files.read_tokens(spark, path)

    run.__name__ = f"tokens_{kind}_round_trip"
    query(_BASE + f"SELECT RecordId, RuleId, CASE WHEN coalesce(Signature, '') = '' THEN '{crypto.BLANK}' ELSE Signature END AS Token FROM s")(run)


def _persons_from(kind: str) -> None:
    def run(spark, sf_dir):
        path = _written(spark, f"persons.{kind}")
        out = persons(spark, sf_dir).write.mode("overwrite")
        if kind == "csv":
            out.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        else:
            out.parquet(path)
        return tokens.signatures(read_persons(spark, path, FieldRegistry.defaults(), kind))

    run.__name__ = f"signatures_from_{kind}"
    query(_BASE + "SELECT RecordId, RuleId, Signature FROM s")(run)


for _n in ("csv", "parquet"):
    _round_trip(_n)
    _persons_from(_n)


@query(_TWO + f'SELECT A_RecordId AS "HospitalRecordId", B_RecordId AS "PharmacyRecordId", rules AS "MatchingTokens", n::VARCHAR AS "TokenCount" FROM ({_PAIRS}) WHERE n >= 2')
def matches_csv_round_trip(spark, sf_dir):
    path = _written(spark, "matches.csv")
    files.write_matches(_overlap(spark, sf_dir).at_least(2), path, {"A_RecordId": "HospitalRecordId", "B_RecordId": "PharmacyRecordId"})
    return spark.read.option("header", True).csv(path)


# ---- validators, types and rules of one's own, reports, forms of tokens, generated tables, streams


@query(
    _with(_ONE)
    + f"""SELECT RecordId, trim(coalesce(FirstName, '')) <> '' AS not_blank, coalesce(lower(FirstName) NOT IN {oracle._NAMES}, false) AS not_in,
    coalesce(NOT regexp_matches(trim(PostalCode), '^(?:{'|'.join(US_POSTAL_REJECTED)})'), false) AS not_starts_with, ok_sx AS regex, ok_bd AS date_range,
    k % 200 + 1850 BETWEEN 1910 AND year(current_date) AS year_range, k % 200 - 20 BETWEEN 0 AND 120 AS age_range, ok_sx OR ok_bd AS any_of
    FROM n JOIN p USING (RecordId) JOIN (SELECT 'C' || c_custkey AS RecordId, c_custkey AS k FROM customer) USING (RecordId)"""
)
def all_validators(spark, sf_dir):
    """Each row predicate on a raw value."""
    k = F.substring("RecordId", 2, 20).cast("long")
    c = {f: F.col(f) for f in ("FirstName", "PostalCode", "Sex", "BirthDate")}
    day = validators.date_range(c["BirthDate"], "1910-01-01", until_today=True) & validators.regex(c["BirthDate"], dates.SHAPE)
    tests = {
        "not_blank": validators.not_blank(c["FirstName"]), "not_in": validators.not_in(c["FirstName"], PLACEHOLDERS),
        "not_starts_with": validators.not_starts_with(c["PostalCode"], US_POSTAL_REJECTED), "regex": validators.regex(c["Sex"], SEX), "date_range": day,
        "year_range": validators.year_range((k % 200 + 1850).cast("string")), "age_range": validators.age_range((k % 200 - 20).cast("string")),
        "any_of": validators.any_of(validators.regex(c["Sex"], SEX), day),
    }
    return persons(spark, sf_dir).select("RecordId", *[t.alias(n) for n, t in tests.items()])


@query(_with(_ONE) + "SELECT RecordId, 'K' AS RuleId, CASE WHEN starts_with(PostalCode, '1') AND ok_sx THEN 'Z' || PostalCode[1:2] || '|' || upper(sx) END AS Signature FROM n JOIN p USING (RecordId)")
def custom_attribute_type(spark, sf_dir):
    """A type from two functions of one's own, under an id and an alias of its own."""
    area = attribute_type("Area", lambda c: c.startswith("1"), lambda c: F.concat(F.lit(" Z"), F.left(c, F.lit(2))), ("PostalCode",))
    registry = FieldRegistry.defaults().register("Region", area)
    return tokens.signatures(persons(spark, sf_dir), RuleSet().add(Rule("K", (Part("Region", "T"), Part("Sex", "T|U")))), registry)


@query(_with(_ONE, oracle.signatures_sql(rules={"Q": (("sx", "upper(sx)"), ("ln", "ln"))})) + "SELECT RecordId, RuleId, Signature FROM s")
def custom_rule_quick(spark, sf_dir):
    return tokens.signatures(persons(spark, sf_dir), quick_rules("Q", [("sex", "T|U"), ("last_name", "T")]))


@query(
    _with(_ONE, oracle.signatures_sql(), oracle.invalid_sql())
    + f"""SELECT 'parquet' AS "OutputFormat", '2.0' AS "TokenDefinitionVersion", (SELECT count(*) FROM p) AS "TotalRows", (SELECT count(*) FROM i) AS "TotalRowsWithInvalidAttributes",
    sha256('{SECRET.decode()}') AS "HashingSecretHash", (SELECT count(*) FROM s WHERE RuleId = 'T1' AND coalesce(Signature, '') = '') AS "BlankT1" """
)
def run_report(spark, sf_dir):
    """The figures of a run's report."""
    report = metadata.document(metadata.counters(persons(spark, sf_dir)).first().asDict(), hashing_secret=SECRET)  # one row
    names = ("OutputFormat", "TokenDefinitionVersion", "TotalRows", "TotalRowsWithInvalidAttributes", "HashingSecretHash")
    schema = "OutputFormat string, TokenDefinitionVersion string, TotalRows long, TotalRowsWithInvalidAttributes long, HashingSecretHash string, BlankT1 long"
    return spark.createDataFrame([(*(report[n] for n in names), report["BlankTokensByRule"]["T1"])], schema)


@query(_BASE + "SELECT RuleId, count(*) AS tokens, count(*) AS packaged, count(*) FILTER (Signature <> '') AS encrypted FROM s GROUP BY RuleId")
def sealed_forms(spark, sf_dir):
    """Envelopes by rule: where tokens are made and sealed in one run blank ones are wrapped too, later encryption leaves them."""
    packaged = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.sealed(SECRET, KEY, RING)).withColumn("form", F.lit("packaged"))
    later = tokens.encrypt_tokens(tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.keyed(SECRET)), KEY, RING).withColumn("form", F.lit("encrypted"))
    wrapped = crypto.is_envelope(F.col("Token"))
    return packaged.union(later).groupBy("RuleId").agg(
        F.count_if(F.col("form") == "packaged").alias("tokens"),
        F.count_if((F.col("form") == "packaged") & wrapped).alias("packaged"),
        F.count_if((F.col("form") == "encrypted") & wrapped).alias("encrypted"),
    )


@query(_BASE + f"SELECT count(*) AS total, 0::BIGINT AS transformed, count(*) FILTER (Token <> '{crypto.BLANK}') AS failed FROM (SELECT {_HMAC} AS Token FROM s)")
def decrypt_summary_wrong_key(spark, sf_dir):
    table = tokens.encrypt_tokens(tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.keyed(SECRET)), KEY, RING)
    return tokens.transform_summary(table, KEY[::-1])


@query(_TOKENS)
def tokens_left_by_a_wrong_key(spark, sf_dir):
    """What another key cannot open stays as it is, and the right key opens it afterwards."""
    sealed = tokens.tokenize(persons(spark, sf_dir), tokens.Pipeline.sealed(SECRET, KEY, RING))
    return tokens.decrypt_tokens(tokens.decrypt_tokens(sealed, KEY[::-1]), KEY)


@query("SELECT 100::BIGINT AS total_records_dataset1, 120::BIGINT AS total_records_dataset2, 40::BIGINT AS matching_records_dataset1, 40::BIGINT AS matching_records_dataset2")
def generated_linkage(spark, sf_dir):
    """Two generated tables that share forty persons under ids of their own."""
    pipe = tokens.Pipeline.sealed(SECRET, KEY, RING)
    left, right = (tokens.tokenize(side, pipe) for side in generate.linked(spark))
    return Overlap(left, right, KEY).summary([["T1", "T3", "T4", "T5"]]).select(*[f"{k}_records_dataset{n}" for k in ("total", "matching") for n in (1, 2)])


@query("SELECT 50::BIGINT AS persons, 150::BIGINT AS records, 3::BIGINT AS most")
def generated_repeats(spark, sf_dir):
    rows = generate.persons(spark, 50, repeats=3)
    same = rows.groupBy(*[c for c in rows.columns if c != "RecordId"]).agg(F.count_distinct("RecordId").alias("n"))
    return same.agg(F.count("*").alias("persons"), F.sum("n").alias("records"), F.max("n").alias("most"))


@query(_TOKENS)
def tokens_streamed(spark, sf_dir):
    """The table as a stream of files, tokens appended to files."""
    root = _written(spark, "stream")
    files.delete(spark, root)
    persons(spark, sf_dir).repartition(3).write.parquet(f"{root}/in")
    source = streaming.person_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, files_per_batch=2)
    streaming.start(source, tokens.Pipeline.keyed(SECRET), f"{root}/out", f"{root}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
