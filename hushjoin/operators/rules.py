"""Token rules: ordered parts of attribute and expression, compiled to signatures."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from hushjoin.functions.expressions import compile_expression
from hushjoin.operators.attributes import TYPES, FieldRegistry


@dataclass(frozen=True)
class Part:
    field: str
    expression: str = "T"

    def __post_init__(self):
        compile_expression(self.expression)  # wrong expressions are reported where the rule is written


@dataclass(frozen=True)
class Rule:
    id: str
    parts: tuple[Part, ...]


@dataclass(frozen=True)
class RuleSet:
    """Rules by id, in order. version is what metadata reports."""

    rules: Mapping[str, Rule] = field(default_factory=dict)
    version: str = "2.0-custom"

    def add(self, rule: Rule) -> RuleSet:
        return RuleSet({**self.rules, rule.id: rule}, self.version)

    def only(self, *ids: str) -> RuleSet:
        return RuleSet({i: self.rules[i] for i in ids}, self.version)

    @property
    def ids(self) -> list[str]:
        return sorted(self.rules)

    @property
    def fields(self) -> list[str]:
        """The fields that the rules read, each once."""
        return list(dict.fromkeys(p.field for r in self.rules.values() for p in r.parts))


def _rule(name: str, *parts: tuple[str, str]) -> Rule:
    return Rule(name, tuple(Part(f, e) for f, e in parts))


# The five rules that come with the engine.
_LAST, _FIRST, _SEX, _BIRTH = ("LastName", "T|U"), ("FirstName", "T|U"), ("Sex", "T|U"), ("BirthDate", "T|D")
DEFAULT = RuleSet(
    {
        "T1": _rule("T1", _LAST, ("FirstName", "T|S(0,1)|U"), _SEX, _BIRTH),
        "T2": _rule("T2", _LAST, _FIRST, _BIRTH, ("PostalCode", "T|S(0,3)|U")),
        "T3": _rule("T3", _LAST, _FIRST, _SEX, _BIRTH),
        "T4": _rule("T4", ("SocialSecurityNumber", r"T|M(\d+)"), _SEX, _BIRTH),
        "T5": _rule("T5", _LAST, ("FirstName", "T|S(0,3)|U"), _SEX),
    },
    version="2.0",
)

SHORT_NAMES = {
    "first_name": "FirstName", "last_name": "LastName", "birth_date": "BirthDate", "sex": "Sex",
    "postal_code": "PostalCode", "ssn": "SocialSecurityNumber", "record_id": "RecordId",
}


class RuleBuilder:
    """RuleBuilder("T6").add("last_name", "T|U").add("ssn").build()"""

    def __init__(self, rule_id: str):
        self.rule_id, self.parts = rule_id, []

    def add(self, attribute: str, expression: str = "T") -> RuleBuilder:
        name = SHORT_NAMES.get(attribute, attribute)
        if name not in TYPES:
            raise ValueError(f"Unknown attribute: {attribute}. Available: {', '.join(SHORT_NAMES)}")
        self.parts.append(Part(name, expression))
        return self

    def build(self) -> Rule:
        return Rule(self.rule_id, tuple(self.parts))


def quick_rules(rule_id: str, attributes: list[tuple[str, str]]) -> RuleSet:
    builder = RuleBuilder(rule_id)
    for name, expression in attributes:
        builder.add(name, expression)
    return RuleSet().add(builder.build())


def list_attributes() -> dict[str, str]:
    return dict(SHORT_NAMES)


def check_fields(rules: RuleSet, registry: FieldRegistry) -> None:
    for f in rules.fields:
        registry[f]
