"""Linkage: golden values, attribute vectors, rule states, crypto round trips, overlap, sources, settings, exchange."""

import base64
import hashlib
import hmac
import json
import warnings
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hushjoin.functions import crypto
from hushjoin.functions.expressions import compile_expression
from hushjoin.functions.text import plain, strip
from hushjoin.operators import metadata, tokens
from hushjoin.operators.attributes import TYPES, FieldRegistry, attribute_type, combined
from hushjoin.operators.overlap import Overlap, OverlapAnalyzer, match_rate
from hushjoin.operators.rules import DEFAULT, Part, Rule, RuleBuilder, RuleSet, quick_rules
from hushjoin.operators.tokens import Pipeline
from hushjoin.sources import config, exchange, files
from hushjoin.sources.persons import canonical, read_persons, require_columns

KEY = "0123456789abcdef0123456789ABCDEF"
PERSON = "RecordId string, FirstName string, LastName string, BirthDate string, Sex string, PostalCode string, SocialSecurityNumber string"


def one(spark, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    t, c = TYPES[kind], F.col("v")
    return [(r.ok, r.n) for r in df.select("i", t.valid(c).alias("ok"), t.normalize(c).alias("n")).orderBy("i").collect()]


VECTORS = {
    "FirstName": (
        {"José": "Jose", "Mr. John": "John", "J": "J", "John123": "John", "Dr Anna B.": "Anna", "Prof.": "Prof", "John Jr.": "John", "  Zoë\t": "Zoe", "Łukasz": "Lukasz", "Æsa": "AEsa", "Mary Ann": "MaryAnn", "Dr. Jr": "Jr", " Bob ": "Bob", "Rev John III": "John", "ǅana": "Dzana", "Anná": "Anna"},
        ["N/A", "n/a", "<masked>", "TEST16", "", "   ", None, "Unknown", "123", "-", "automation test"],
    ),
    "LastName": (
        {"Li": "Li", "Wu": "Wu", "Ek": "Ek", "Ng": "Ng", "ng": "ng", "Smith-Jones": "SmithJones", "O'Brien": "OBrien", "Smith III": "Smith", "Müller Jr": "Muller", "Van 2nd": "Van", "Straße": "Strasse"},
        ["D", "Mn", "Pq", "Xz", "missing", None, "", "Test1"],
    ),
    "BirthDate": (
        {"2020-02-29": "2020-02-29", "2001/10/26": "2001-10-26", "10/26/2001": "2001-10-26", "10-26-2001": "2001-10-26", "26.10.2001": "2001-10-26", "2001-10-26T23:59:59Z": "2001-10-26", "2001-10-26T01:02:03.123+02:00": "2001-10-26", "1910-01-01": "1910-01-01"},
        ["20011026", "1800-01-01", "2950-01-01", " 2001-10-26", "2001-02-30", "2001-13-01", "2001-10-26T01:02:03", "2001-10-26T25:02:03Z", "1909-12-31", "", None],
    ),
    "Sex": ({"M": "Male", "f": "Female", "Male": "Male", "male": "Male", " female ": "Female"}, ["MALE", "U", "", None, "Mal"]),
    "PostalCode": (
        {"10001-6789": "10001", " 95123": "95123", "k1b0a6": "K1B 0A6", "1563": "15630", "980": "98000", "J1X": "J1X 000", "T2X 3": "T2X 3A0", "M4C 5A": "M4C 5A0", "100016789": "10001"},
        ["12345", "00000", "55512", "K1A", "A1A 1A1", "H0H 0H0", "abc", "12", "123456", "", None, "K1A0A6", "M7A1"],
    ),
    "SocialSecurityNumber": (
        {"223-45-6789": "223-45-6789", "223456789.0": "223-45-6789", "2234567": "002-23-4567", "123456789": "123-45-6789", "22345678": "022-34-5678", "000000000": "000-00-0000", "223456789.": "223-45-6789", "22345-6789": "223-45-6789"},
        ["666-00-0000", "900-45-6789", "123-11-0000", "123-45-6789", "111-11-1111", "12345", "1234567890", "", None, "223-00-6789", "666-12-1234"],
    ),
    "Integer": ({"+007": "7", "-0": "0", " 12\n": "12", "-0450": "-450", "9" * 40: "9" * 40}, ["1.5", "x", "", None]),
    "Year": ({"1999": "1999", "0099": "99", "0000": "0"}, ["99", "12345"]),
    "Age": ({"0": "0", "120": "120", "+5": "5"}, ["121", "-1", "5.2"]),
    "USPostalCode": ({"951": "951", "10001": "10001"}, ["12345"]),
    "CanadianPostalCode": ({"k1b0a6": "K1B 0A6", "J1X": "J1X"}, ["X0X 0X0", "10001"]),
}


@pytest.mark.parametrize("kind", VECTORS)
def test_attribute_vectors(spark, kind):
    good, bad = VECTORS[kind]
    for (k, v), got in zip(good.items(), one(spark, list(good), kind)):
        assert got == (True, v), k
    for k, (ok, _) in zip(bad, one(spark, bad, kind)):
        assert ok is False, k


def test_decimal_is_written_like_python(spark):
    values = ["1", "-0.0", "1e10", "1e15", "1e16", "123456789012345680", "1.5e300", ".5", "2.", "0.0001", "0.00001", "1.234E-7", "12345678.9", "9999999.5", "10000000", "123.456e3", "1e-300", "0"]
    for v, (ok, n) in zip(values, one(spark, values, "Decimal")):
        assert ok and n == str(float(v)), v


def test_strip_and_plain(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0   　"
    values = [f"{b}x y{b}" for b in blanks] + ["Ǽ Đ ŋ", "Ünïcödé", "한글", "Ångstrom"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [tuple(r) for r in df.orderBy("i").select(strip(F.col("v")), plain(F.col("v"))).collect()]
    assert [g[0] for g in got] == [v.strip() for v in values]
    assert [g[1] for g in got][-4:-2] == ["AE D ng", "Unicode"] and got[-1][1] == "Angstrom"


@pytest.mark.parametrize(
    "expression, value, want",
    [("T", "  a ", "a"), ("U", "aß", "ASS"), ("T|S(0,3)|U", " john ", "JOH"), ("S(2,10)", "abc", "c"), ("S(-3,2)", "abc", "ab"), ("S(1,-1)", "abcd", "bc"), ("S(3,1)", "abcd", ""), ("R('a','xy')", "banana", "bxynxynxy"), ("R('','-')", "ab", "ab"), (r"M(\d+)", "a12b3", "123"), ("D", "2001-2-3", "2001-02-03"), ("D", "nope", None), ("", " x ", " x "), ("T", "  ", ""), ("T", None, ""), (" t | u ", " a ", "A")],
)
def test_expressions(spark, expression, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    got = df.select(compile_expression(expression)(F.col("v")).alias("x")).first().x
    if expression == "R('','-')":
        assert got in (want, "-a-b-")
    else:
        assert got == want


@pytest.mark.parametrize("wrong", ["X", "S(1)", "S(a,b)", "S", "R('a')", "R(a,b)", "M(", "M((a)(b))", "T||U"])
def test_wrong_expressions_are_reported(wrong):
    with pytest.raises(ValueError):
        Part("LastName", wrong)


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("r1", "Alice", "Wonderland", "1993-08-10", "F", None, "345-54-6795"),
        ("r2", "Bob", "Builder", "01/02/1980", "Male", "10001", "223456789"),
        ("r3", "N/A", "X", "bad", "U", "12345", ""),
    ]
    return spark.createDataFrame(rows, PERSON)


def test_golden_signatures_and_tokens(people):
    sig = {(r.RecordId, r.RuleId): r.Signature for r in tokens.signatures(people).collect()}
    want = {"T1": "WONDERLAND|A|FEMALE|1993-08-10", "T2": None, "T3": "WONDERLAND|ALICE|FEMALE|1993-08-10", "T4": "345546795|FEMALE|1993-08-10", "T5": "WONDERLAND|ALI|FEMALE"}
    assert {k[1]: v for k, v in sig.items() if k[0] == "r1"} == want
    got = {r.RuleId: r.Token for r in tokens.tokenize(people, Pipeline.hash_only()).filter("RecordId = 'r1'").collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() if v else crypto.BLANK for k, v in want.items()}
    keyed = {r.RuleId: r.Token for r in tokens.tokenize(people, Pipeline.keyed("s3cret")).filter("RecordId = 'r1'").collect()}
    digest = hmac.new(b"s3cret", got["T1"].encode(), hashlib.sha256).digest()
    assert keyed["T1"] == base64.b64encode(digest).decode() and keyed["T2"] == crypto.BLANK
    long = b"k" * 100
    assert tokens.tokenize(people, Pipeline.keyed(long)).filter("RecordId = 'r1' and RuleId = 'T1'").first().Token == base64.b64encode(hmac.new(long, got["T1"].encode(), hashlib.sha256).digest()).decode()
    bad = {r.Token for r in tokens.tokenize(people, Pipeline.plain()).filter("RecordId = 'r3'").collect()}
    assert bad == {crypto.BLANK}


def test_counters(people):
    row = metadata.counters(people).first().asDict()
    assert row["total"] == 3
    assert {k: v for k, v in row.items() if k.startswith("blank")} == {"blank_T1": 1, "blank_T2": 2, "blank_T3": 1, "blank_T4": 1, "blank_T5": 1}
    # a rule stops at its first invalid part: only those are counted
    assert row["invalid_LastName"] == 1 and row["invalid_FirstName"] == 0 and row["invalid_PostalCode"] == 1 and row["invalid_SocialSecurityNumber"] == 1
    doc = metadata.document(row, hashing_secret="a", encryption_key=None)
    assert doc["TotalRowsWithInvalidAttributes"] == sum(doc["InvalidAttributesByType"].values()) and "EncryptionSecretHash" not in doc
    full = {r.RecordId: r.invalid for r in tokens.invalid_attributes(people, DEFAULT.fields).collect()}
    assert full["r3"] == ["BirthDate", "FirstName", "LastName", "PostalCode", "Sex", "SocialSecurityNumber"]


def test_three_states_of_a_rule(spark):
    rules = RuleSet().add(Rule("D", (Part("When", "T"), Part("Name", "T")))).add(Rule("N", (Part("Name", "D"),)))
    registry = FieldRegistry().register("When", "Date").register("Name", "String")
    df = spark.createDataFrame([("a", "2001-01-01", "x"), ("b", "2001-13-45", "x"), ("c", "no", "x"), ("d", "2001-01-01", " ")], "RecordId string, When string, Name string")
    got = {(r.RecordId, r.RuleId): r.Signature for r in tokens.signatures(df, rules, registry).collect()}
    assert got == {("a", "D"): "2001-01-01|x", ("c", "D"): None, ("d", "D"): None, ("a", "N"): None, ("b", "N"): None, ("c", "N"): None, ("d", "N"): None}


def test_sealed_tokens(people):
    plain_tokens = {(r.RecordId, r.RuleId): r.Token for r in tokens.tokenize(people, Pipeline.keyed("s")).collect()}
    sealed = tokens.tokenize(people, Pipeline.sealed("s", KEY, "ring")).collect()
    assert all(r.Token.startswith("olt.V1.") and "\r" not in r.Token for r in sealed)
    head = json.loads(base64.urlsafe_b64decode(sealed[0].Token.split(".")[2] + "=="))
    assert head == {"alg": "dir", "enc": "A256GCM", "typ": "match-token", "kid": "ring"}
    spark = people.sparkSession
    df = spark.createDataFrame([tuple(r) for r in sealed], "RecordId string, RuleId string, Token string")
    payload = json.loads(df.select(crypto.open_envelope(F.col("Token"), KEY.encode())).first()[0])
    assert set(payload) == {"rlid", "hash_alg", "mac_alg", "ppid", "rid", "iss", "iat"} and payload["rid"] == "ring"
    assert {(r.RecordId, r.RuleId): r.Token for r in tokens.decrypt_tokens(df, KEY).collect()} == plain_tokens
    other = "x" * 32
    assert {r.Token for r in tokens.decrypt_tokens(df, other).collect()} == {r.Token for r in sealed}
    assert tuple(tokens.transform_summary(df, other).first()) == (15, 0, 15)


def test_decrypt_leaves_what_it_cannot_open(spark):
    values = [None, "", "plain", "olt.V1.a.b", "olt.V1." + "." * 4, "QUJD", "A" * 80, crypto.BLANK, "olt.V2.x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(crypto.decrypt(F.col("v"), KEY.encode())).collect()] == values


def test_strict_decryption_raises(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([("a", "T1", "tok"), ("b", "", "tok"), ("c", "T1", crypto.BLANK), ("d", "T1", ""), ("e", "T1", None)], "RecordId string, RuleId string, Token string")
    sealed = tokens.encrypt_tokens(df, KEY)
    assert sorted(map(repr, tokens.decrypt_tokens(sealed, KEY, strict=True).collect())) == sorted(map(repr, df.collect()))
    for table, key in ((sealed, "x" * 32), (df, KEY)):
        with pytest.raises(PySparkException, match="Decryption failed"):
            tokens.decrypt_tokens(table, key, strict=True).collect()


def test_counts_come_with_the_tokens(spark, people, tmp_path):
    made, seen = tokens.tokenize_counted(people.drop("RecordId"), Pipeline.hash_only())
    made.write.parquet(str(tmp_path / "t"))
    assert seen.get == metadata.counters(people).first().asDict()
    sealed = tokens.encrypt_tokens(spark.read.parquet(str(tmp_path / "t")), KEY)
    sealed.write.parquet(str(tmp_path / "s"))
    for key, count in ((KEY, "transformed"), ("x" * 32, "failed")):
        opened, seen = tokens.decrypt_counted(spark.read.parquet(str(tmp_path / "s")), key)
        opened.write.mode("overwrite").parquet(str(tmp_path / "o"))
        assert seen.get == tokens.transform_summary(spark.read.parquet(str(tmp_path / "s")), key).first().asDict() and seen.get[count] == 9


def test_types_of_ones_own(spark):
    code = attribute_type("Code", lambda c: c.startswith("c"), lambda c: F.concat(c, F.lit(" ")), ("Key",))
    registry = FieldRegistry().register("Code", code)
    rules = RuleSet().add(Rule("K", (Part("Code", "T|U"),))).add(Rule("L", (Part("Code", ""),)))
    df = spark.createDataFrame([("a", "c1"), ("b", "x"), ("c", None)], "RecordId string, Key string")
    got = {(r.RecordId, r.RuleId): r.Signature for r in tokens.signatures(df, rules, registry).collect()}
    assert got == {("a", "K"): "C1", ("a", "L"): "c1 ", ("b", "K"): None, ("b", "L"): None, ("c", "K"): None, ("c", "L"): None}


def test_written_tables_answer_alike(spark, people, tmp_path):
    left = tokens.tokenize(people, Pipeline.sealed("s", KEY, "one"))
    right = tokens.tokenize(people.withColumn("RecordId", F.concat("RecordId", F.lit("x"))), Pipeline.sealed("s", KEY, "two"))
    over = Overlap(left, right, KEY.encode())
    again = over.written(str(tmp_path))
    sets = [["T1"], ["T1", "T2"], ["T4", "T5"]]
    assert sorted(again.summary(sets).collect()) == sorted(over.summary(sets).collect())
    assert sorted(again.matches(["T1"]).collect()) == sorted(over.matches(["T1"]).collect()) and again.key is None


def test_match_rate(spark):
    four, none = spark.range(4), spark.range(0)
    assert tuple(match_rate(spark.range(3), four).first()) == (3, 4, 75.0) and tuple(match_rate(none, none).first()) == (0, 0, 0.0)


def test_extensions(capsys):
    import argparse

    from hushjoin import extensions

    class Good:
        command = "good"

        def register(self, commands):
            commands.add_parser("good").set_defaults(run=lambda args, spark: print("ran"))

    class Other(Good):
        command = "other"

    class Point:
        def __init__(self, name, target):
            self.name, self.target = name, target

        def load(self):
            if isinstance(self.target, Exception):
                raise self.target
            return self.target

    parser = argparse.ArgumentParser()
    found = [Point("wrong", Other), Point("tokenize", type("T", (Good,), {"command": "tokenize"})), Point("good", Good), Point("broken", ImportError("none"))]
    with pytest.warns(UserWarning, match="left out"):
        assert extensions.add_commands(parser.add_subparsers(), {"tokenize"}, found) == ["good"]
    args = parser.parse_args(["good"])
    args.run(args, None)
    assert capsys.readouterr().out == "ran\n"


def test_encrypting_a_table(spark):
    df = spark.createDataFrame([("a", "T1", "tok"), ("b", "", "tok"), ("c", "T1", crypto.BLANK), ("d", "T1", ""), ("e", "T1", None)], "RecordId string, RuleId string, Token string")
    enc = {r.RecordId: r.Token for r in tokens.encrypt_tokens(df, KEY).collect()}
    assert enc["a"].startswith("olt.V1.") and not enc["b"].startswith("olt.") and enc["c"] == crypto.BLANK and enc["d"] == "" and enc["e"] is None


@pytest.mark.parametrize("key", [None, "", "  ", "short", b"x" * 31])
def test_keys_are_checked(key):
    with pytest.raises(ValueError):
        crypto.key_bytes(key)
    with pytest.raises(ValueError):
        OverlapAnalyzer(key)


def overlap_tables(spark):
    left = [(r, t, f"{r}{t}") for r in ("rec1", "rec2", "rec3") for t in ("T1", "T2", "T3")]
    right = [(n, t, f"{r}{t}") for r, n in (("rec1", "rec10"), ("rec2", "rec11"), ("recX", "rec12")) for t in ("T1", "T2", "T3")]
    schema = "RecordId string, RuleId string, Token string"
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def test_overlap(spark):
    left, right = overlap_tables(spark)
    results = OverlapAnalyzer(KEY).compare(left, right, [["T1"], ["T1", "T2", "T3"], ["T1", "T1"], ["T9"]], "A", "B")
    assert [r["matching_records_dataset1"] for r in results] == [2, 2, 0, 0]  # a repeated rule can never be met
    assert results[1]["unique_to_dataset2"] == 1 and abs(results[1]["overlap_percentage"] - 200 / 3) < 1e-9
    assert {tuple(r) for r in results[1]["matches"].collect()} == {("rec1", "rec10"), ("rec2", "rec11")}
    assert "66.67%" in OverlapAnalyzer.summary_text(results[1])
    over = Overlap(left, right)
    assert {r.RecordId for r in over.only_left(["T1"]).collect()} == {"rec3"}
    assert over.at_least(3).count() == 2 and over.tiered([["T1", "T9"], ["T2"]]).count() == 2
    with pytest.raises(ValueError):
        over.matches([])
    with pytest.raises(ValueError):
        Overlap(left.drop("Token"), right)
    empty = Overlap(left.limit(0), right.limit(0)).summary([["T1"]]).first()
    assert empty.overlap_percentage == 0 and empty.total_records_dataset1 == 0


def test_blank_tokens_match_each_other_unless_left_out(spark):
    schema = "RecordId string, RuleId string, Token string"
    left, right = (spark.createDataFrame([(x, "T1", crypto.BLANK)], schema) for x in "ab")
    assert Overlap(left, right).matches(["T1"]).count() == 1
    assert Overlap(left, right, include_blank=False).matches(["T1"]).count() == 0


@pytest.mark.parametrize("include_blank", [True, False])
@pytest.mark.parametrize("repeats", [0, 25])
def test_counts_match_brute_force(spark, include_blank, repeats):
    """Blank tokens, missing rules and, with repeats, several tokens of a record for one rule."""
    import random

    rng = random.Random(repeats)
    rules, schema, sides = ["T1", "T2", "T3"], "RecordId string, RuleId string, Token string", []
    for name in "ab":
        rows = [(f"{name}{i}", r, rng.choice([crypto.BLANK, crypto.BLANK, *"vwxyz"])) for i in range(40) for r in rules if rng.random() < 0.9]
        sides.append(rows + [rng.choice(rows)[:2] + (rng.choice([crypto.BLANK, "v"]),) for _ in range(repeats)])
    left, right = sides
    pairs = [(a, b, r) for a, r, t in left for b, q, u in right if r == q and t == u and (include_blank or t != crypto.BLANK)]
    over = Overlap(*(spark.createDataFrame(x, schema) for x in sides), include_blank=include_blank)
    sets = [["T1"], ["T1", "T2"], ["T3", "T1", "T2"], ["T1", "T1"], ["T9"]]
    got = {r.rules: r for r in over.summary(sets).collect()}
    for s in sets:
        hit = {p for p, n in Counter((a, b) for a, b, r in pairs if r in s).items() if n == len(s)}
        r = got[",".join(s)]
        assert (r.matching_records_dataset1, r.matching_records_dataset2) == (len({a for a, _ in hit}), len({b for _, b in hit})), s
        assert {x.RecordId for x in over.only_left(s).collect()} == {a for a, _, _ in left} - {a for a, _ in hit}
        assert Counter(tuple(x) for x in over.matches(s).collect()) == Counter(hit)
    assert {r.RuleId: r.pairs for r in over.pairs_by_rule().collect()} == Counter(r for _, _, r in pairs)
    assert {r.TokenCount: r.pairs for r in over.by_count().collect()} == Counter(Counter((a, b) for a, b, _ in set(pairs)).values())


def test_blank_records_are_counted_without_their_pairs(spark):
    """A hundred thousand blank records a side have 10^10 pairs."""
    left, right = (spark.range(100_000).select(F.concat(F.lit(x), "id").alias("RecordId"), F.lit("T1").alias("RuleId"), F.lit(crypto.BLANK).alias("Token")) for x in "ab")
    over = Overlap(left, right)
    assert over.summary([["T1"]]).first().matching_records_dataset1 == 100_000 and over.only_left(["T1"]).count() == 0
    assert over.by_count().first().pairs == over.pairs_by_rule().first().pairs == 10**10


def test_pairs_of_one_class_are_made_by_several_tasks(spark):
    """Two thousand blank records a side are one class of four million pairs; no task makes half of them."""
    left, right = (spark.range(2000).select(F.concat(F.lit(x), "id").alias("RecordId"), F.lit("T1").alias("RuleId"), F.lit(crypto.BLANK).alias("Token")) for x in "ab")
    found = Overlap(left, right).matches(["T1"])
    assert found.groupBy("Dataset1_RecordId").agg(F.count_distinct("Dataset2_RecordId").alias("n"), F.count("*").alias("m")).filter("n = 2000 and m = 2000").count() == 2000
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 2_000_000


@pytest.mark.parametrize("block", [(1, 3), (4, 1000)])
def test_blocks_of_classes_match_brute_force(spark, monkeypatch, block):
    """Classes of all sizes in small blocks, on sides of unlike size, with records without an id."""
    from hushjoin.operators import overlap

    monkeypatch.setattr(overlap, "CLASS_PAIRS", 4)
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "SPREAD", 3)
    left = [(f"a{i}" if i else None, "T1", "vvvvvvvwxy"[i % 10]) for i in range(60)]
    right = [(f"b{i}" if i else None, "T1", "vwwxyz"[i % 6]) for i in range(19)]
    over = Overlap(*(spark.createDataFrame(x, "RecordId string, RuleId string, Token string") for x in (left, right)))
    assert Counter(tuple(x) for x in over.matches(["T1"]).collect()) == Counter((a, b) for a, _, t in left for b, _, u in right if t == u)


def test_written_pairs_take_little_disk(spark, tmp_path):
    """Eight million pairs of blank records, whole: ids are written once and repeat in short runs, well under a byte a pair."""
    left, right = (spark.range(n).select(F.concat(F.lit(x), "id").alias("RecordId"), F.lit("T1").alias("RuleId"), F.lit(crypto.BLANK).alias("Token")) for x, n in (("a", 200), ("b", 40000)))
    Overlap(left, right).matches(["T1"]).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs").groupBy("Dataset2_RecordId").agg(F.collect_set("Dataset1_RecordId").alias("met"), F.count("*").alias("n"))
    assert found.filter("n = 200 and size(met) = 200").count() == found.count() == 40000
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.4 * 200 * 40000


def test_cells_of_a_class_are_dealt_evenly(spark):
    left, right = (spark.range(8000).select(F.concat(F.lit(x), "id").alias("RecordId"), F.lit("T1").alias("RuleId"), F.lit(crypto.BLANK).alias("Token")) for x in "ab")
    counts = [r["count"] for r in Overlap(left, right).matches(["T1"]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 64_000_000 and max(counts) < 1.3 * min(counts)


@pytest.mark.parametrize("sizes", [(1, 90), (90, 1), (2, 45), (33, 37)])
def test_runs_of_classes_match_brute_force(spark, monkeypatch, sizes):
    """One class in more blocks than tasks on a side, in runs that do not divide it."""
    from hushjoin.operators import overlap

    for name, value in (("CLASS_PAIRS", 4), ("BLOCK", (1, 2)), ("SPREAD", 2), ("RUN", 2)):
        monkeypatch.setattr(overlap, name, value)
    left, right = ([(f"{x}{i}", "T1", "v") for i in range(n)] for x, n in zip("ab", sizes))
    over = Overlap(*(spark.createDataFrame(x, "RecordId string, RuleId string, Token string") for x in (left, right)))
    assert Counter(tuple(x) for x in over.matches(["T1"]).collect()) == Counter((a, b) for a, _, _ in left for b, _, _ in right)


def test_column_aliases(spark, people):
    renamed = people.selectExpr("RecordId AS Id", "FirstName AS GivenName", "LastName AS Surname", "BirthDate AS DateOfBirth", "Sex AS Gender", "PostalCode AS ZipCode", "SocialSecurityNumber AS NationalIdentificationNumber", "1 AS other")
    assert {tuple(r) for r in tokens.signatures(renamed).collect()} == {tuple(r) for r in tokens.signatures(people).collect()}
    no_id = people.drop("RecordId")
    assert tokens.signatures(no_id).select("RecordId").distinct().count() == 3
    with pytest.raises(ValueError, match="Missing required columns"):
        require_columns(people.drop("Sex"), FieldRegistry.defaults())
    require_columns(people, FieldRegistry.defaults())
    missing = tokens.signatures(people.drop("PostalCode")).filter("RuleId = 'T2'").collect()
    assert all(r.Signature is None for r in missing)
    assert "PostalCode" not in {t for r in tokens.checked(people.drop("PostalCode")).collect() for t in r.invalid}


def test_empty_table_and_custom_rules(spark, people):
    assert tokens.tokenize(people.limit(0), Pipeline.hash_only()).count() == 0
    rule = RuleBuilder("T6").add("last_name", "T|U").add("ssn").build()
    rules = RuleSet().add(rule)
    assert rules.version == "2.0-custom" and DEFAULT.version == "2.0"
    assert tokens.signatures(people, rules).filter("RecordId = 'r2'").first().Signature == "BUILDER|223-45-6789"
    assert quick_rules("Q", [("sex", "T|U")]).ids == ["Q"]
    with pytest.raises(ValueError):
        RuleBuilder("x").add("nothing")
    with pytest.raises(ValueError):
        tokens.signatures(people, RuleSet().add(Rule("x", (Part("NoField"),))))
    either = combined("Either", TYPES["Integer"], TYPES["Year"])
    df = spark.createDataFrame([("+7",), ("x ",)], "v string")
    assert [tuple(r) for r in df.select(either.valid(F.col("v")), either.normalize(F.col("v"))).collect()] == [(True, "7"), (False, "x")]


def test_files(spark, people, tmp_path):
    table = tokens.tokenize(people, Pipeline.hash_only())
    want = {tuple(r) for r in table.select("RuleId", "Token", "RecordId").collect()}
    for kind in ("csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        files.write_tokens(table, path)
        assert {tuple(r) for r in files.read_tokens(spark, path).collect()} == want
    with pytest.raises(ValueError):
        people.write.mode("overwrite").parquet(str(tmp_path / "p.parquet"))
        files.read_tokens(spark, str(tmp_path / "p.parquet"))
    people.write.option("header", True).csv(str(tmp_path / "p"))
    back = read_persons(spark, str(tmp_path / "p"), FieldRegistry.defaults(), "csv")
    assert {tuple(r) for r in tokens.signatures(back).collect()} == {tuple(r) for r in tokens.signatures(people).collect()}
    assert files.auto_output_path("a/b.csv", "tokenize") == "a/b_tokenized.csv" and files.auto_output_path("b.csv", "package") == "b_packaged.zip"
    assert files.detect_type("X.CSV") == "csv" and files.metadata_path("a/b.parquet") == "a/b.metadata.json"
    with pytest.raises(ValueError):
        files.detect_type("x.zip")
    files.write_json(spark, str(tmp_path / "m.json"), {"a": "ß"})
    files.bundle(spark, str(tmp_path / "z.zip"), str(tmp_path / "m.json"), str(tmp_path / "t.parquet"))
    assert json.loads(zipfile.ZipFile(tmp_path / "z.zip").read("m.json")) == {"a": "ß"}
    names = zipfile.ZipFile(tmp_path / "z.zip").namelist()
    assert "m.json" in names and any(n.startswith("t.parquet/part-") for n in names)


def test_settings(spark, tmp_path):
    text = """
column_mappings:
  RecordId: {column_name: visit, type: RecordId}
  Given: {column_name: first, type: GivenName}
  A: {column_name: "age now", type: Age}
token_rules:
  R1: [{field: Given, expression: T|U}, {field: A, expression: T}]
"""
    (tmp_path / "c.yaml").write_text(text)
    s = config.load(str(tmp_path / "c.yaml"))
    df = spark.createDataFrame([("v1", "ann", "54"), ("v2", "bob", "54.2")], "visit string, FIRST string, `age now` string")
    got = {r.RecordId: r.Signature for r in tokens.signatures(canonical(df, s.registry, s.columns), s.rules, s.registry).collect()}
    assert got == {"v1": "ANN|54", "v2": None} and s.rules.version == "custom"
    ok = {"column_mappings": {"RecordId": {"column_name": "a", "type": "RecordId"}}, "token_rules": {"R": [{"field": "RecordId", "expression": "T"}]}}
    for wrong in ([], {}, {**ok, "token_rules": {}}, {**ok, "column_mappings": {"x": {"type": "Sex"}}}, {**ok, "column_mappings": {"x": {"column_name": "a", "type": "Nope"}}}, {**ok, "token_rules": {"R": [{"field": "q", "expression": "T"}]}}, {**ok, "token_rules": {"R": [{"field": "RecordId", "expression": "Z"}]}}, {**ok, "token_rules": {"R": []}}):
        with pytest.raises(ValueError), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            config.parse(wrong)


def test_exchange(spark, tmp_path):
    pairs = [exchange.generate_key_pair("P-256") for _ in range(2)]
    doc = exchange.build("demo", pairs[0][1], pairs[1][1], b"s" * 32)
    sides = [exchange.resolve(value=json.dumps(doc), private_key_value=p) for p, _ in pairs]
    assert [s.role for s in sides] == ["sender", "recipient"] and sides[0].hashing_secret == b"s" * 32
    keys = [exchange.transport_key(s) for s in sides]
    assert keys[0] == keys[1] and len(keys[0]) == 32
    pipe = Pipeline.from_exchange("ring", value=doc, private_key_value=pairs[0][0])
    assert (pipe.secret, pipe.key, pipe.ring) == (b"s" * 32, keys[0], "ring")
    assert OverlapAnalyzer.from_exchange(value=doc, private_key_value=pairs[1][0]).key == keys[0]
    exchange.save_key_pair(tmp_path, "me", *pairs[1])
    assert exchange.resolve(value=doc, folder=tmp_path).role == "recipient"
    stranger = exchange.generate_key_pair("P-384")[0]
    with pytest.raises(ValueError):
        exchange.resolve(value=doc, private_key_value=stranger)
    with pytest.raises(ValueError):
        exchange.load(value={"version": 9})
    with pytest.raises(ValueError):
        exchange.load(path="x", value="{}")
    with pytest.raises(FileNotFoundError):
        exchange.load(path=tmp_path / "none")
    with pytest.raises(ValueError):
        exchange.find_private_key(doc, env="X", environment={})
    assert exchange.hkdf(bytes.fromhex("0b" * 22), bytes.fromhex("000102030405060708090a0b0c"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_streaming(spark, people, tmp_path):
    from hushjoin.streaming.tokens import person_stream, start

    people.write.parquet(str(tmp_path / "in"))
    stream = person_stream(spark, str(tmp_path / "in"), people.schema)
    q = start(stream, Pipeline.hash_only(), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in tokens.tokenize(people, Pipeline.hash_only()).collect()}


def test_plan_is_native(people):
    plan = tokens.tokenize(people, Pipeline.keyed("s"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
