"""Synthetic persons from row numbers: any size, the same rows for the same seed, no state between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("Alice", "Bruno", "Chloé", "David", "Elena", "Farid", "Grace", "Hugo", "Inés", "Jonas", "Kira", "Liam", "Mona", "Nils", "Olga", "Pavel")
FAMILY = ("Almeida", "Becker", "Castro", "Dubois", "Eriksen", "Fischer", "García", "Horváth", "Ivanov", "Jensen", "Kowalski", "Lindqvist", "Moreau", "Novák", "O'Neill", "Petrov", "Quinn", "Rossi", "Silva", "Tanaka")


def _draw(key: Column, seed: int, what: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{what}"), key), F.lit(n))


def _from(values, key: Column, seed: int, what: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(key, seed, what, len(values)) + 1).cast("int"))


def persons(spark: SparkSession, n: int, seed: int = 42, first: int = 0, prefix: str = "R", repeats: int = 1) -> DataFrame:
    """n persons numbered from `first`, each `repeats` times under ids of their own."""
    rows = spark.range(n * repeats).withColumn("k", F.floor(F.col("id") / repeats) + first)
    k = F.col("k")
    ssn = F.lpad((_draw(k, seed, "a", 665) + 1).cast("string"), 3, "0"), F.lpad((_draw(k, seed, "g", 99) + 1).cast("string"), 2, "0"), F.lpad((_draw(k, seed, "s", 9999) + 1).cast("string"), 4, "0")
    return rows.select(
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("RecordId"),
        _from(GIVEN, k, seed, "given").alias("FirstName"),
        _from(FAMILY, k, seed, "family").alias("LastName"),
        F.date_add(F.lit("1930-01-01").cast("date"), _draw(k, seed, "birth", 30_000).cast("int")).cast("string").alias("BirthDate"),
        F.when(_draw(k, seed, "sex", 2) == 0, "Male").otherwise("Female").alias("Sex"),
        F.lpad((_draw(k, seed, "zip", 89_999) + 10_000).cast("string"), 5, "0").alias("PostalCode"),
        F.concat_ws("-", *ssn).alias("SocialSecurityNumber"),
    )


def linked(spark: SparkSession, left: int = 100, right: int = 120, shared: int = 40, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two tables under ids of their own, of which `shared` persons are the same."""
    return persons(spark, left, seed, 0, "L"), persons(spark, right, seed, left - shared, "R")
