"""Counts of a tokenization run, in one pass, and the flat document that reports them."""

from __future__ import annotations

import hashlib
import platform

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushjoin.operators.attributes import FieldRegistry
from hushjoin.operators.rules import DEFAULT, RuleSet
from hushjoin.operators.tokens import checked, counters  # noqa: F401  counters belong to the report


def invalid_by_type(persons: DataFrame, rules: RuleSet = DEFAULT, registry: FieldRegistry | None = None) -> DataFrame:
    """attribute, records."""
    return checked(persons, rules, registry).select(F.explode_outer("invalid").alias("attribute")).filter("attribute is not null").groupBy("attribute").agg(F.count("*").alias("records"))


def blank_by_rule(persons: DataFrame, rules: RuleSet = DEFAULT, registry: FieldRegistry | None = None) -> DataFrame:
    """RuleId, records."""
    return checked(persons, rules, registry).select(F.explode_outer("blank").alias("RuleId")).filter("RuleId is not null").groupBy("RuleId").agg(F.count("*").alias("records"))


def secret_hash(secret: str | bytes | None) -> str | None:
    if not secret:
        return None
    return hashlib.sha256(secret.encode() if isinstance(secret, str) else secret).hexdigest()


def document(row: dict, rules: RuleSet = DEFAULT, output_format: str = "parquet", hashing_secret=None, encryption_key=None) -> dict:
    """The report of a run from its counters. A record with two invalid attributes counts twice in the sum."""
    pick = lambda p: {k[len(p) :]: int(v) for k, v in sorted(row.items()) if k.startswith(p)}
    invalid, blank = pick("invalid_"), pick("blank_")
    out = {
        "Platform": "PySpark", "PythonVersion": platform.python_version(), "OutputFormat": output_format, "TokenDefinitionVersion": rules.version,
        "TotalRows": int(row["total"]), "TotalRowsWithInvalidAttributes": sum(invalid.values()),
        "InvalidAttributesByType": invalid, "BlankTokensByRule": blank,
    }
    hashes = {"HashingSecretHash": secret_hash(hashing_secret), "EncryptionSecretHash": secret_hash(encryption_key)}
    return out | {k: v for k, v in hashes.items() if v}


def tokens_by_rule(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("RuleId").agg(F.count("*").alias("tokens"))


def tokens_per_record(tokens: DataFrame) -> DataFrame:
    """How many records have how many tokens."""
    return tokens.groupBy("RecordId").agg(F.count("*").alias("tokens")).groupBy("tokens").agg(F.count("*").alias("records"))
