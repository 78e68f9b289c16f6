"""Headline linkage queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("tokens_hash_only", "tokens_hmac", "tokens_sealed", "run_counters", "overlap_all_rules", "overlap_k_of_n", "overlap_summary")
RUNS = 3
COPIES = 20


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rowwise(persons: DataFrame, secret: bytes) -> DataFrame:
    """The yardstick: rules T3 and T5 with keyed hashes, row by row in a pandas UDF over already normalized columns."""
    import base64
    import hashlib
    import hmac

    @F.pandas_udf("array<string>")
    def tokens(last: pd.Series, first: pd.Series, sex: pd.Series, birth: pd.Series) -> pd.Series:
        out = []
        for x, y, s, b in zip(last, first, sex, birth):
            row = []
            for parts in ((x, y, s, b), (x, y and y[:3], s)):
                if any(p is None for p in parts):
                    row.append("0" * 64)
                else:
                    hexed = hashlib.sha256("|".join(p.upper() for p in parts).encode()).hexdigest()
                    row.append(base64.b64encode(hmac.new(secret, hexed.encode(), hashlib.sha256).digest()).decode())
            out.append(row)
        return pd.Series(out)

    return persons.select("RecordId", F.explode(tokens("LastName", "FirstName", "Sex", "BirthDate")).alias("Token"))


def timed(make) -> float:
    best = None
    for _ in range(RUNS):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        best = took if best is None else min(best, took)
    return round(best, 3)


def main() -> None:
    from hushjoin.operators import tokens
    from hushjoin.operators.attributes import TYPES
    from hushjoin.operators.rules import DEFAULT
    from hushjoin.plans import queries as Q

    spark = session()
    found = Q.queries()
    out = {name: timed(lambda name=name: found[name](spark, SF_DIR)) for name in QUERIES}
    persons = Q.persons(spark, SF_DIR)
    many = persons.crossJoin(spark.range(COPIES)).drop("id")  # enough rows that planning does not count

    def native(rows: DataFrame) -> DataFrame:
        return tokens.tokenize(rows, tokens.Pipeline.keyed(Q.SECRET), DEFAULT.only("T3", "T5"))

    def by_row(rows: DataFrame) -> DataFrame:  # planned within the time, as the native side is
        return rowwise(rows.select("RecordId", *[TYPES[c].value(F.col(c)).alias(c) for c in ("LastName", "FirstName", "Sex", "BirthDate")]), Q.SECRET)

    extra = {}
    for name, make in (("native", native), ("rowwise", by_row)):
        extra[f"{name}_t3_t5_hmac"] = timed(lambda: make(persons))
        extra[f"{name}_t3_t5_hmac_x{COPIES}"] = timed(lambda: make(many))
    print(json.dumps({"metric": "linkage_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "yardstick": extra, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
