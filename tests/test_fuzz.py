"""Attribute columns against a row model in plain Python, over seeded random values of awkward pieces."""

import random
import re
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hushjoin.functions.text import TRANSLITERATION
from hushjoin.operators import attributes as A

PIECES = [
    " ", "\t", "\n", "\x1c", "\x85", " ", "　", ".", "-", "'", "/", ",", "Mr", "mrs.", "Dr. ", "prof ", "Rev", "Jr", "jr.", " III", " 2nd", " V", "Sr.", "José", "Zoë", "ß", "Ł", "Æ", "ŋ", "é",
    "A", "b", "Ng", "O", "Test", "N/A", "unknown", "Smith", "van", "0", "1", "12", "000", "555", "12345", "98765", "123-45-6789", "223-45-6789", "666", "K1A", "k1a0b1", "m5v 2t6", "H0H", "T", "Z", "+02:00",
    "2001-02-03", "02/03/2001", "31.12.1999", "1899-01-01", "T10:11:12", ".123", ":", "M", "f", "Male", "female", "+", "e5", "E-7", ".5", "9" * 9, "中", "한", "١", "٢٠٠١-02-0", "١٢٣٤٥٦٧", "1２",
]


def values(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) for _ in range(n)]


def bare(v):
    v = "".join(TRANSLITERATION.get(c, c) for c in v.strip())
    return "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c)[0] != "M")


def cut(pattern, v, flags=0):
    return re.sub(pattern, "", v, flags=flags)


def first(v):
    v = bare(v)
    v = cut(A.TITLE, v, re.I).strip() or v
    v = cut(A.SUFFIX, v, re.I).strip() or v
    return cut("[^a-zA-Z]", cut(A.LAST_INITIAL, v).strip())


def last(v):
    v = bare(v)
    short = cut(A.SUFFIX, v, re.I)
    return cut("[^a-zA-Z]", short if short.strip() else v)


def named(v):
    return v.lower() not in {p.lower() for p in A.PLACEHOLDERS}


def first_ok(v):
    return bool(v.strip()) and named(v) and bool(first(v)) and named(first(v))


def last_ok(v):
    n = last(v)
    return bool(v.strip()) and named(v) and named(n) and (len(n) > 2 or len(n) == 2 and (bool(re.search("[aeiouAEIOU]", n)) or n.lower() == "ng"))


def day(v):
    v = v.strip()
    for f in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y", "%d.%m.%Y", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z"):
        try:
            return datetime.strptime(v, f).date()
        except ValueError:
            continue
    return None


def birth_ok(v):
    return bool(re.match(A.dates.SHAPE, v)) and (d := day(v)) is not None and date(1910, 1, 1) <= d <= date.today()


def us_ok(v):
    return bool(re.match(A.US_POSTAL, v)) and not v.strip().startswith(A.US_POSTAL_REJECTED)


def ssn_ok(v):
    return bool(v.strip()) and v.lower() not in A.SSN_REJECTED and bool(re.match(A.SSN, v))


def ssn(v):
    d = re.sub(r"\s", "", v).replace("-", "").split(".")[0]
    d = d if len(d) == 9 else f"{int(d):09d}"
    return f"{d[:3]}-{d[3:5]}-{d[5:]}"


MODEL = {
    "FirstName": (first_ok, first),
    "LastName": (last_ok, last),
    "BirthDate": (birth_ok, lambda v: day(v).isoformat()),
    "Sex": (lambda v: bool(re.match(A.SEX, v)), lambda v: {"m": "Male", "f": "Female"}[v.strip()[0].lower()]),
    "USPostalCode": (us_ok, lambda v: v.strip() if len(v.strip()) < 5 else v.strip()[:5]),
    "SocialSecurityNumber": (ssn_ok, ssn),
    "Date": (lambda v: bool(re.match(A.dates.SHAPE, v)), lambda v: d.strftime("%Y-%m-%d") if (d := day(v)) else v.strip()),
    "Year": (lambda v: bool(re.match(A.YEAR, v)), lambda v: str(int(v.strip()))),
    "Integer": (lambda v: bool(re.match(A.INTEGER, v)), lambda v: str(int(v.strip()))),
    "Decimal": (lambda v: bool(re.match(A.DECIMAL, v)), lambda v: str(float(v.strip()))),
}


@pytest.mark.parametrize("kind", MODEL)
def test_columns_equal_the_row_model(spark, kind):
    seen = sorted(set(values(4000, 7)) | {"٢٠٠١-02-03", "2001-02-1٣", "2001-0٢-03", "٠٠٠٠-01-01", "0099-01-01", "٢٣٤٥٦٧٨", "٢٢٣-٤٥-٦٧٨٩", "١٢", "-٠٠٧", "٣.٥", "٢٠٠١"} | {"1e22", "-1.50e-9", "123456789012345678901234567890", "0.1e1"})
    ok, norm = MODEL[kind]
    t, c = A.TYPES[kind], F.col("v")
    df = spark.createDataFrame([(v,) for v in seen], "v string").repartition(4)
    for r in df.select("v", t.valid(c).alias("ok"), t.normalize(c).alias("n")).collect():
        assert r.ok == ok(r.v), repr(r.v)
        if r.ok:
            assert r.n == norm(r.v), repr(r.v)
