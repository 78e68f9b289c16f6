"""Person rows to tokens: one projection, no Python on the executors.

Attributes are validated and normalized once each, then rules take what they need. A rule ends in one of three
states: a token, the blank token (a part is missing, invalid or cannot be read, or nothing is left), or no row (a valid
value that cannot be normalized).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hushjoin.functions import crypto, validators
from hushjoin.functions.expressions import compile_expression, compile_settled
from hushjoin.functions.text import is_blank
from hushjoin.operators.attributes import FieldRegistry
from hushjoin.operators.rules import DEFAULT, RuleSet, check_fields
from hushjoin.sources.persons import resolve_columns


@dataclass(frozen=True)
class Pipeline:
    """What is done to a signature. hashed: SHA-256 first; then the keyed hash, AES and the envelope, each if it has its key.

    wrap_blank: blank tokens get an envelope too (as when tokens are made and sealed in one run).
    """

    hashed: bool = True
    secret: bytes | None = None
    key: bytes | None = None
    envelope: bool = True
    wrap_blank: bool = True
    ring: str = field(default_factory=lambda: str(uuid.uuid4()))

    @classmethod
    def plain(cls) -> Pipeline:
        """Signatures as they are."""
        return cls(hashed=False)

    @classmethod
    def hash_only(cls) -> Pipeline:
        return cls()

    @classmethod
    def keyed(cls, secret: str | bytes) -> Pipeline:
        return cls(secret=crypto.secret_bytes(secret))

    @classmethod
    def sealed(cls, secret: str | bytes | None, key: str | bytes, ring: str | None = None, envelope: bool = True) -> Pipeline:
        """Keyed hash, AES, envelope. Without a secret the signature itself is encrypted."""
        raw = crypto.secret_bytes(secret) if secret is not None else None
        return cls(raw is not None, raw, crypto.key_bytes(key), envelope, envelope, (ring or "").strip() or str(uuid.uuid4()))

    @classmethod
    def from_exchange(cls, ring: str | None = None, **inputs) -> Pipeline:
        """Secret and transport key of exchange settings. inputs: those of exchange.resolve()."""
        from hushjoin.sources import exchange

        found = exchange.resolve(**inputs)
        return cls.sealed(found.hashing_secret, exchange.transport_key(found), ring)

    def token(self, signature: Column, rule: str) -> Column:
        blank = F.coalesce(signature, F.lit("")) == ""  # a signature has no blank parts
        out = crypto.sha256_hex(signature) if self.hashed else signature
        if self.secret is not None:
            out = crypto.hmac_base64(out, self.secret)
        if self.key is not None:
            out = crypto.aes_encrypt(out, self.key)
        out = F.when(blank, F.lit(crypto.BLANK)).otherwise(out)
        if self.key is not None and self.envelope:
            wrapped = crypto.envelope(out, F.lit(rule), self.ring, self.key)
            out = wrapped if self.wrap_blank else F.when(blank, out).otherwise(wrapped)
        return out


def _col(kind: str, name) -> Column:
    return F.col(f"`__{kind}_{name}`")


def _fallible(rules: RuleSet, registry: FieldRegistry) -> list[str]:
    """Fields whose valid values may be unreadable."""
    return [f for f in rules.fields if registry[f].shape is not None]


def _read(persons: DataFrame, rules: RuleSet, registry: FieldRegistry) -> tuple[DataFrame, list[str]]:
    """RecordId and, for each field f that rules read, its normalized value __value_f (null: invalid) and, where values
    may be unreadable, __fails_f; and the fields that have a column."""
    check_fields(rules, registry)
    raw = resolve_columns(persons, rules.fields, registry)
    there = [f for f in rules.fields if f"__raw_{f}" in raw.columns]
    values = [(registry[f].value(_col("raw", f)) if f in there else F.lit(None).cast("string")).alias(f"__value_{f}") for f in rules.fields]
    shaped = [f for f in _fallible(rules, registry) if f in there]
    seen = [F.coalesce(validators.regex(_col("raw", f), registry[f].shape), F.lit(False)).alias(f"__shaped_{f}") for f in shaped]
    out = raw.select("RecordId", *values, *seen)
    if shaped:
        out = out.withColumns({f"__fails_{f}": _col("shaped", f) & _col("value", f).isNull() for f in shaped})
    return out, there


def _states(persons: DataFrame, rules: RuleSet, registry: FieldRegistry) -> DataFrame:
    """RecordId and, for each rule r, __sig_r (null: blank), __bad_r (type of its first invalid field, null: none) and, if it
    may have no row, __none_r.

    Values are read in one stage, the parts that rules share in the next, so that nothing is worked out twice. The first part
    that gives nothing decides: an invalid value makes a rule blank, an unreadable one gives it no row.
    """
    read, there = _read(persons, rules, registry)
    wanted = dict.fromkeys((p.field, p.expression) for rid in rules.ids for p in rules.rules[rid].parts)
    number = {part: n for n, part in enumerate(wanted)}
    fails = [f for f in _fallible(rules, registry) if f in there]
    parts = []
    for (f, expression), n in number.items():
        kind, c = registry[f], _col("value", f)
        made = compile_settled(expression, kind.settled)(c) if kind.settled else F.when(c.isNotNull(), compile_expression(expression)(c))
        parts.append(made.alias(f"__part_{n}"))
    cut = read.select("RecordId", *[_col("value", f) for f in rules.fields], *[_col("fails", f) for f in fails], *parts)
    out = ["RecordId"]
    for rid in rules.ids:
        rule, names, absent, before = rules.rules[rid], [], [], None
        missing = F.lit(None).cast("string")
        for p in rule.parts:
            part, value = _col("part", number[p.field, p.expression]), _col("value", p.field)
            if p.field in there:
                invalid = value.isNull() & ~_col("fails", p.field) if p.field in fails else value.isNull()
                names.append((invalid, F.lit(registry[p.field].name)))
            names.append((part.isNull(), missing))
            if p.field in fails:
                absent.append(_col("fails", p.field) if before is None else before & _col("fails", p.field))
            before = part.isNotNull() if before is None else before & part.isNotNull()
        seen = [_col("part", number[p.field, p.expression]) for p in rule.parts]
        out.append(F.when(before, F.concat_ws("|", *[F.when(~is_blank(x), x) for x in seen])).alias(f"__sig_{rid}"))
        bad = F
        for test, name in names:
            bad = bad.when(test, name)
        out.append(bad.alias(f"__bad_{rid}"))
        if absent:
            out.append(reduce(Column.__or__, absent).alias(f"__none_{rid}"))
    return cut.select(*out)


def _rows(states: DataFrame, rules: RuleSet, name: str, value) -> DataFrame:
    """RecordId, RuleId and value(rule): a row a rule. inline_outer, since the optimizer would repeat the array of a plain inline in a filter."""
    rows = [F.struct(F.lit(rid).alias("RuleId"), value(rid).alias(name)) for rid in rules.ids]
    some = [f"__none_{rid}" in states.columns for rid in rules.ids]
    rows = [F.when(~_col("none", rid), row) if may else row for rid, row, may in zip(rules.ids, rows, some)]
    made = F.array_compact(F.array(*rows)) if any(some) else F.array(*rows)
    out = states.select("RecordId", F.inline_outer(made))
    return out.filter("RuleId is not null") if any(some) else out


def signatures(persons: DataFrame, rules: RuleSet = DEFAULT, registry: FieldRegistry | None = None) -> DataFrame:
    """RecordId, RuleId and Signature (null: blank), one row a rule."""
    return _rows(_states(persons, rules, registry or FieldRegistry.defaults()), rules, "Signature", lambda rid: _col("sig", rid))


def tokenize(persons: DataFrame, pipeline: Pipeline, rules: RuleSet = DEFAULT, registry: FieldRegistry | None = None) -> DataFrame:
    """RecordId, RuleId, Token. Works on streaming DataFrames too: it is a projection."""
    return _rows(_states(persons, rules, registry or FieldRegistry.defaults()), rules, "Token", lambda rid: pipeline.token(_col("sig", rid), rid))


def counts_of(states: DataFrame, rules: RuleSet, registry: FieldRegistry) -> list[Column]:
    """Aggregates over _states(): total, invalid_<type> for every type that rules read, blank_<rule> for every rule.

    A record counts once for a type, however many rules come upon its invalid value.
    """
    found = F.array(*[_col("bad", rid) for rid in rules.ids])
    no_row = lambda rid: _col("none", rid) if f"__none_{rid}" in states.columns else F.lit(False)
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.array_contains(found, n)).alias(f"invalid_{n}") for n in sorted({registry[f].name for f in rules.fields})],
        *[F.count_if(~no_row(rid) & is_blank(_col("sig", rid))).alias(f"blank_{rid}") for rid in rules.ids],
    ]


def tokenize_counted(persons: DataFrame, pipeline: Pipeline, rules: RuleSet = DEFAULT, registry: FieldRegistry | None = None) -> tuple[DataFrame, Observation]:
    """tokenize() and the counters of the same pass: observation.get is there once the tokens have been written."""
    registry, seen = registry or FieldRegistry.defaults(), Observation()
    states = _states(persons, rules, registry)
    states = states.observe(seen, *counts_of(states, rules, registry))
    return _rows(states, rules, "Token", lambda rid: pipeline.token(_col("sig", rid), rid)), seen


def counters(persons: DataFrame, rules: RuleSet = DEFAULT, registry: FieldRegistry | None = None) -> DataFrame:
    """One row: total, invalid_<type> for every type that rules read, blank_<rule> for every rule."""
    registry = registry or FieldRegistry.defaults()
    states = _states(persons, rules, registry)
    return states.agg(*counts_of(states, rules, registry))


def checked(persons: DataFrame, rules: RuleSet = DEFAULT, registry: FieldRegistry | None = None) -> DataFrame:
    """RecordId, invalid (names of all types with an invalid value that rules came upon), blank (rules that are blank)."""
    states = _states(persons, rules, registry or FieldRegistry.defaults())
    seen = F.array_compact(F.array(*[_col("bad", rid) for rid in rules.ids]))
    blank = [is_blank(_col("sig", rid)) & (~_col("none", rid) if f"__none_{rid}" in states.columns else F.lit(True)) for rid in rules.ids]
    names = F.array_compact(F.array(*[F.when(b, F.lit(rid)) for b, rid in zip(blank, rules.ids)]))
    return states.select("RecordId", F.sort_array(F.array_distinct(seen)).alias("invalid"), names.alias("blank"))


def invalid_attributes(persons: DataFrame, fields: list[str], registry: FieldRegistry | None = None) -> DataFrame:
    """RecordId and the names of all given fields whose value is invalid, whatever rules read them."""
    registry = registry or FieldRegistry.defaults()
    raw = resolve_columns(persons, fields, registry)
    there = [f for f in fields if f"__raw_{f}" in raw.columns]
    bad = [F.when(~F.coalesce(registry[f].valid(_col("raw", f)), F.lit(False)), F.lit(registry[f].name)) for f in there]
    return raw.select("RecordId", F.sort_array(F.array_distinct(F.array_compact(F.array(*bad)))).alias("invalid"))


def encrypt_tokens(tokens: DataFrame, key: str | bytes, ring: str | None = None) -> DataFrame:
    """Encrypt a token table: AES and envelope; bare AES where a row has no rule. Blank and empty tokens stay."""
    raw, ring = crypto.key_bytes(key), (ring or "").strip() or str(uuid.uuid4())
    c = F.col("Token")
    sealed = crypto.aes_encrypt(c, raw)
    wrapped = F.when(is_blank(F.col("RuleId")), sealed).otherwise(crypto.envelope(sealed, F.col("RuleId"), ring, raw))
    return tokens.withColumn("Token", F.when(crypto.real(c), wrapped).otherwise(c))


def decrypt_tokens(tokens: DataFrame, key: str | bytes, strict: bool = False) -> DataFrame:
    """Decrypt a token table. Blank and empty tokens stay, as does what cannot be opened; strict: that raises when rows are read."""
    raw, c = crypto.key_bytes(key), F.col("Token")
    opened = crypto.decrypt_strict(c, raw) if strict else crypto.decrypt(c, raw)
    return tokens.withColumn("Token", F.when(crypto.real(c), opened).otherwise(c))


def _transform_counts(tried: Column, ok: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), F.count_if(tried & ok).alias("transformed"), F.count_if(tried & ~ok).alias("failed")]


def transform_summary(tokens: DataFrame, key: str | bytes) -> DataFrame:
    """total, transformed and failed of a decryption run: one row."""
    raw, c = crypto.key_bytes(key), F.col("Token")
    return tokens.agg(*_transform_counts(crypto.real(c), F.coalesce(crypto.decrypt_ok(c, raw), F.lit(False))))


def decrypt_counted(tokens: DataFrame, key: str | bytes) -> tuple[DataFrame, Observation]:
    """decrypt_tokens() and transform_summary() of the same pass: observation.get is there once the tokens have been written.

    Every token is opened once: one that stays as it is has not been opened.
    """
    seen, name = Observation(), "__was"
    opened = decrypt_tokens(tokens.withColumn(name, F.col("Token")), key)
    counts = _transform_counts(crypto.real(F.col(name)), F.col("Token") != F.col(name))
    return opened.observe(seen, *counts).drop(name), seen


def record_id_hashes(df: DataFrame) -> DataFrame:
    """RecordId replaced by its SHA-256."""
    return df.withColumn("RecordId", crypto.sha256_hex(F.col("RecordId")))

