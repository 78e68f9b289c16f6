"""Tokenization settings in YAML: column_mappings {field: {column_name, type}} and token_rules {rule: [{field, expression}]}."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from hushjoin.operators.attributes import TYPES, FieldRegistry
from hushjoin.operators.rules import Part, Rule, RuleSet


@dataclass(frozen=True)
class Settings:
    columns: dict[str, str]
    registry: FieldRegistry
    rules: RuleSet


def _section(doc: dict, name: str) -> dict:
    found = doc.get(name)
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{name} must be a mapping that is not empty")
    return found


def _need(entry, key: str, where: str) -> str:
    if not isinstance(entry, dict) or not str(entry.get(key) or "").strip():
        raise ValueError(f"{where} needs {key}")
    return str(entry[key])


def parse(doc) -> Settings:
    """Settings from the decoded document; ValueError says what is wrong with it."""
    if not isinstance(doc, dict):
        raise ValueError("the settings must be a mapping")
    columns, fields = {}, {}
    by_alias = {a: t for t in TYPES.values() for a in t.aliases} | TYPES
    for name, entry in _section(doc, "column_mappings").items():
        columns[name] = _need(entry, "column_name", name)
        kind = _need(entry, "type", name)
        if kind not in by_alias:
            raise ValueError(f"{name} has unknown type {kind}")
        fields[name] = by_alias[kind]
    if "RecordId" not in fields:
        warnings.warn("no RecordId is mapped: ids will be made", stacklevel=2)
    rules = {}
    for rid, parts in _section(doc, "token_rules").items():
        if not isinstance(parts, list) or not parts:
            raise ValueError(f"{rid} must be a list that is not empty")
        made = []
        for p in parts:
            f = _need(p, "field", rid)
            if f not in fields:
                raise ValueError(f"{rid} has unknown field {f}")
            made.append(Part(f, _need(p, "expression", rid)))
        rules[str(rid)] = Rule(str(rid), tuple(made))
    return Settings(columns, FieldRegistry(fields), RuleSet(rules, "custom"))


def load(path: str) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))
