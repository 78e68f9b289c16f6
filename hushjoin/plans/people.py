"""A person table made from the keys of customer, with clean and dirty values; one statement for both engines."""

from __future__ import annotations


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "' || chr(39) || '") + "'"


def _pick(key: str, values: list[str | None]) -> str:
    return f"CASE {key} % {len(values)} {' '.join(f'WHEN {i} THEN {_text(v)}' for i, v in enumerate(values))} END"


FIRST = ["Alice", "José", "Dr. Maria", "John Jr.", "Anna B.", "  Émile ", "N/A", "", None, "TEST16", "Łukasz", "Jean-Luc", "Prof Zoë", "MISSING", "Straße", "O'Neil"]
LAST = ["Smith", "Garcia", "Müller", "O'Brien", "Smith-Jones", "Nguyen III", "Li", "Ng", "Pq", "D", "Unknown", None, "", "Søren", "García Sr.", "<masked>", "Wonderland", "Lee", "van Dyke"]
SEX = ["M", "F", "m", "f", "Male", "Female", "male", "female", " M ", "MALE", "U", None, ""]


#: A second table over the same keys: every third one is the same person, the others are persons of other keys.
OTHER_KEYS = "CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 7000003 END"


def view(prefix: str = "C", keys: str = "c_custkey") -> str:
    """SELECT of the seven person columns for every customer. keys: the number that a person is made from."""
    k = "k"
    day = f"CAST(DATE '1930-01-01' + CAST(({k} * 37) % 25000 AS INT) AS STRING)"
    y, m, d = (f"substr({day}, {a}, {n})" for a, n in ((1, 4), (6, 2), (9, 2)))
    birth = (
        f"CASE {k} % 13 WHEN 0 THEN {y} || '/' || {m} || '/' || {d} WHEN 1 THEN {m} || '/' || {d} || '/' || {y} WHEN 2 THEN {m} || '-' || {d} || '-' || {y} "
        f"WHEN 3 THEN {d} || '.' || {m} || '.' || {y} WHEN 4 THEN {day} || 'T10:15:30Z' WHEN 5 THEN {day} || 'T10:15:30.123+02:00' WHEN 6 THEN '1800-01-01' "
        f"WHEN 7 THEN '2020-02-30' WHEN 8 THEN NULL WHEN 9 THEN ' ' || {day} WHEN 10 THEN {day} || 'T10:15:30' ELSE {day} END"
    )
    five = f"lpad(CAST(({k} * 7919) % 100000 AS STRING), 5, '0')"
    postal = (
        f"CASE {k} % 11 WHEN 0 THEN {five} || '-1234' WHEN 1 THEN substr({five}, 1, 3) WHEN 2 THEN substr({five}, 1, 4) WHEN 3 THEN 'K1A 0A6' WHEN 4 THEN 'm5v2t6' "
        f"WHEN 5 THEN 'J1X' WHEN 6 THEN 'H0H' WHEN 7 THEN ' ' || {five} || ' ' WHEN 8 THEN '12345' WHEN 9 THEN NULL ELSE {five} END"
    )
    area, group, serial = f"lpad(CAST(({k} * 31) % 1000 AS STRING), 3, '0')", f"lpad(CAST({k} % 100 AS STRING), 2, '0')", f"lpad(CAST(({k} * 13) % 10000 AS STRING), 4, '0')"
    ssn = (
        f"CASE {k} % 9 WHEN 0 THEN {area} || {group} || {serial} WHEN 1 THEN {area} || {group} || {serial} || '.0' WHEN 2 THEN substr({area} || {group} || {serial}, 1, 7) "
        f"WHEN 3 THEN '123-45-6789' WHEN 4 THEN '666-12-3456' WHEN 5 THEN NULL WHEN 6 THEN {area} || {group} ELSE {area} || '-' || {group} || '-' || {serial} END"
    )
    return (
        f"SELECT '{prefix}' || CAST(c_custkey AS STRING) AS RecordId, {birth} AS BirthDate, {_pick(k, FIRST)} AS FirstName, "
        f"{_pick(f'({k} * 7)', LAST)} AS LastName, {postal} AS PostalCode, {_pick(f'({k} * 5)', SEX)} AS Sex, {ssn} AS SocialSecurityNumber FROM (SELECT c_custkey, {keys} AS k FROM customer)"
    )
