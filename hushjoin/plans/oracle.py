"""SQL for DuckDB that says, for the person view's alphabet, what the linkage queries must return."""

from __future__ import annotations

from hushjoin.functions.crypto import BLANK
from hushjoin.operators.attributes import CA_POSTAL_REJECTED, PLACEHOLDERS, SSN_REJECTED, SUFFIX, TITLE, US_POSTAL_REJECTED
from hushjoin.plans import people

_TITLE, _SUFFIX = f"(?i){TITLE}", f"(?i){SUFFIX}"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_NAMES = _in(v.lower() for v in PLACEHOLDERS)


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _left(new: str, old: str) -> str:
    return f"CASE WHEN {new} <> '' THEN {new} ELSE {old} END"


def people_sql(prefix: str = "C", keys: str = "c_custkey", name: str = "") -> str:
    """CTEs p<name> (raw), ... n<name>: normalized columns fn ln bd sx pc sn, and whether each is valid: ok_fn ..."""
    n = name
    plain = lambda c: f"replace(translate({_strip(c)}, 'ÉéíóëüøŁł', 'EeioeuoLl'), 'ß', 'ss')"
    day = (
        "CASE WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') THEN v WHEN regexp_matches(v, '^\\d{4}/\\d{2}/\\d{2}$') THEN replace(v, '/', '-') "
        "WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{3})?(Z|[+-]\\d{2}:\\d{2})$') THEN v[1:10] "
        "WHEN regexp_matches(v, '^\\d{2}[-/]\\d{2}[-/]\\d{4}$') THEN v[7:10] || '-' || v[1:2] || '-' || v[4:5] "
        "WHEN regexp_matches(v, '^\\d{2}\\.\\d{2}\\.\\d{4}$') THEN v[7:10] || '-' || v[4:5] || '-' || v[1:2] END"
    ).replace("(v,", "(BirthDate,").replace("THEN v", "THEN BirthDate").replace(" v[", " BirthDate[")
    starts = " OR ".join(f"starts_with({_strip('PostalCode')}, '{x}')" for x in US_POSTAL_REJECTED)
    sn = "regexp_replace(SocialSecurityNumber, '-', '', 'g')"
    bare = "regexp_matches(SocialSecurityNumber, '^\\d{7,9}(\\.0*)?$')"
    dashed = f"(regexp_matches(SocialSecurityNumber, '^\\d{{3}}-?\\d{{2}}-?\\d{{4}}$') AND {sn}[1:3] NOT IN ('000', '666') AND {sn}[1:1] <> '9' AND {sn}[4:5] <> '00' AND {sn}[6:9] <> '0000')"
    digits = f"regexp_replace({sn}, '\\..*$', '')"
    ca = "upper(regexp_replace(PostalCode, '\\s+', '', 'g'))"
    return f"""p{n} AS (
  {people.view(prefix, keys)}
), a{n} AS (
  SELECT *, {plain('FirstName')} AS f0, {plain('LastName')} AS l0, try_cast({day} AS DATE) AS d0, regexp_replace(PostalCode, '\\s+', '', 'g') AS z0,
    regexp_matches(PostalCode, '^\\s*(\\d{{3}}|\\d{{4}}|\\d{{5}}(-\\d{{4}})?|\\d{{9}})\\s*$') AND NOT ({starts}) AS us FROM p{n}
), b{n} AS (
  SELECT *, {_left(_strip(f"regexp_replace(f0, '{_TITLE}', '')"), 'f0')} AS f1, {_left(_strip(f"regexp_replace(l0, '{_SUFFIX}', '')"), 'l0')} AS l1,
    CASE length({ca}) WHEN 3 THEN {ca} || ' 000' WHEN 4 THEN {ca}[1:3] || ' ' || {ca}[4:4] || 'A0' WHEN 5 THEN {ca}[1:3] || ' ' || {ca}[4:5] || '0' ELSE {ca}[1:3] || ' ' || {ca}[4:6] END AS ca FROM a{n}
), c{n} AS (
  SELECT *, {_left(_strip(f"regexp_replace(f1, '{_SUFFIX}', '')"), 'f1')} AS f2, regexp_replace(l1, '[^a-zA-Z]', '', 'g') AS ln,
    regexp_matches(PostalCode, '^\\s*[A-Za-z]\\d[A-Za-z](\\s?\\d([A-Za-z]\\d?)?)?\\s*$') AND ca NOT IN {_in(CA_POSTAL_REJECTED)} AND NOT regexp_matches(ca, '^(K1A|M7A|H0H) (000|\\d[A-Z]0)$') AS ok_ca FROM b{n}
), e{n} AS (
  SELECT *, regexp_replace({_strip("regexp_replace(f2, '\\s[^\\s]\\.?$', '')")}, '[^a-zA-Z]', '', 'g') AS fn FROM c{n}
), n{n} AS (
  SELECT RecordId, fn, ln, strftime(d0, '%Y-%m-%d') AS bd, CASE lower({_strip('Sex')}[1:1]) WHEN 'm' THEN 'Male' WHEN 'f' THEN 'Female' END AS sx,
    CASE WHEN us THEN CASE length(z0) WHEN 3 THEN z0 || '00' WHEN 4 THEN z0 || '0' ELSE z0[1:5] END WHEN ok_ca THEN ca ELSE {_strip('PostalCode')} END AS pc,
    CASE WHEN regexp_matches({digits}, '^\\d{{7,9}}$') THEN lpad({digits}, 9, '0')[1:3] || '-' || lpad({digits}, 9, '0')[4:5] || '-' || lpad({digits}, 9, '0')[6:9] ELSE SocialSecurityNumber END AS sn,
    coalesce({_strip('FirstName')} <> '' AND lower(FirstName) NOT IN {_NAMES} AND fn <> '' AND lower(fn) NOT IN {_NAMES}, false) AS ok_fn,
    coalesce({_strip('LastName')} <> '' AND lower(LastName) NOT IN {_NAMES} AND (length(ln) > 2 OR length(ln) = 2 AND (regexp_matches(ln, '[aeiouAEIOU]') OR lower(ln) = 'ng')) AND lower(ln) NOT IN {_NAMES}, false) AS ok_ln,
    coalesce(d0 BETWEEN DATE '1910-01-01' AND current_date, false) AS ok_bd,
    coalesce(regexp_matches(Sex, '^\\s*([Mm](ale)?|[Ff](emale)?)\\s*$'), false) AS ok_sx,
    coalesce(us OR ok_ca, false) AS ok_pc,
    coalesce(SocialSecurityNumber NOT IN {_in(SSN_REJECTED)} AND ({bare} OR {dashed}), false) AS ok_sn FROM e{n}
)"""


_RULES = {
    "T1": (("ln", "upper(ln)"), ("fn", "upper(fn[1:1])"), ("sx", "upper(sx)"), ("bd", "bd")),
    "T2": (("ln", "upper(ln)"), ("fn", "upper(fn)"), ("bd", "bd"), ("pc", "upper(pc[1:3])")),
    "T3": (("ln", "upper(ln)"), ("fn", "upper(fn)"), ("sx", "upper(sx)"), ("bd", "bd")),
    "T4": (("sn", "regexp_replace(sn, '[^0-9]', '', 'g')"), ("sx", "upper(sx)"), ("bd", "bd")),
    "T5": (("ln", "upper(ln)"), ("fn", "upper(fn[1:3])"), ("sx", "upper(sx)")),
}
TYPES = {"fn": "FirstName", "ln": "LastName", "bd": "BirthDate", "sx": "Sex", "pc": "PostalCode", "sn": "SocialSecurityNumber"}


def signatures_sql(name: str = "", rules: dict | None = None) -> str:
    """CTE s<name>: RecordId, RuleId, Signature (null: blank)."""
    rows = [f"SELECT RecordId, '{r}' AS RuleId, CASE WHEN {' AND '.join(f'ok_{c}' for c, _ in parts)} THEN concat_ws('|', {', '.join(x for _, x in parts)}) END AS Signature FROM n{name}" for r, parts in (rules or _RULES).items()]
    return f"s{name} AS (\n  " + "\n  UNION ALL ".join(rows) + "\n)"


def invalid_sql(name: str = "") -> str:
    """CTE i<name>: RecordId, attribute: the first invalid attribute of each rule, each once."""
    rows = []
    for parts in _RULES.values():
        rows.append(f"SELECT RecordId, CASE {' '.join(f'WHEN NOT ok_{c} THEN {chr(39)}{TYPES[c]}{chr(39)}' for c, _ in parts)} END AS attribute FROM n{name}")
    return f"i{name} AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(rows)}) WHERE attribute IS NOT NULL)"


def hmac_sql(text: str, secret: bytes) -> str:
    """Base64 HMAC-SHA256 of a text expression, spelled out with both pads."""
    key = secret.ljust(64, b"\0")
    inner, outer = (f"unhex('{bytes(b ^ pad for b in key).hex()}')" for pad in (0x36, 0x5C))
    return f"to_base64(unhex(sha256({outer} || unhex(sha256({inner} || encode({text}))))))"


def token_sql(secret: bytes | None) -> str:
    hashed = "sha256(Signature)"
    return f"CASE WHEN coalesce(Signature, '') = '' THEN '{BLANK}' ELSE {hmac_sql(hashed, secret) if secret else hashed} END"
