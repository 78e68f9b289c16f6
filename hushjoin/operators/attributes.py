"""Attribute types: how a raw value is validated and normalized, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushjoin.functions import dates, validators
from hushjoin.functions.text import ascii_digits, let, matches, passing, plain, squeeze_out, strip, swap


@dataclass(frozen=True)
class AttributeType:
    """name: also the key of invalid counts. value: the normalized value, null where the raw value is invalid or cannot be read.

    shape: what a raw value must match to be valid although it may be unreadable, so that its rules give no row.
    settled: expression steps that change nothing on a normalized value. Normalized values are stripped and never blank.
    """

    name: str
    aliases: tuple[str, ...]
    value: Callable[[Column], Column]
    shape: str | None = None
    settled: str = "T"

    def fails(self, c: Column) -> Column:
        """The raw value is valid and cannot be read."""
        return F.lit(False) if self.shape is None else validators.regex(c, self.shape) & self.value(c).isNull()

    def valid(self, c: Column) -> Column:
        return self.value(c).isNotNull() if self.shape is None else validators.regex(c, self.shape)

    def normalize(self, c: Column) -> Column:
        """The normalized value; an invalid one is only stripped."""
        return F.coalesce(self.value(c), strip(c))


def attribute_type(name: str, valid: Callable[[Column], Column], normalize: Callable[[Column], Column], aliases: tuple[str, ...] = ()) -> AttributeType:
    """A type of one's own, from a predicate and a normalizer of raw values."""
    return AttributeType(name, (name, *aliases), lambda c: F.when(valid(c), normalize(c)), settled="")


# Names that stand for no name.
PLACEHOLDERS = (
    "Unknown", "N/A", "None", "Test", "Sample", "Donor", "Patient", "Automation Test", "Automationtest", "patient not found",
    "patientnotfound", "<masked>", "Anonymous", "zzztrash", "Missing", "Unavailable", "Not Available", "NotAvailable",
)

# Starts of US postal codes that are no real ones.
US_POSTAL_REJECTED = ("11111", "22222", "33333", "66666", "77777", "99999", "01234", "12345", "54321", "98765", "000", "555", "888")

# Canadian postal codes that are no real ones, and areas that are rejected where only the area is given.
CA_POSTAL_REJECTED = ("A1A 1A1", "X0X 0X0", "Y0Y 0Y0", "Z0Z 0Z0", "A0A 0A0", "B1B 1B1", "C2C 2C2", "K1A 0A6", "H0H 0H0")
CA_AREAS_REJECTED = ("K1A", "M7A", "H0H")

# Social security numbers that are no real ones.
SSN_REJECTED = (
    "111-11-1111", "222-22-2222", "333-33-3333", "444-44-4444", "555-55-5555", "777-77-7777", "888-88-8888", "001-01-0001",
    "001-01-0101", "001-01-9999", "001-10-0110", "001-11-1111", "001-12-2334", "001-23-4567", "007-77-7777", "010-10-1010",
    "011-11-1111", "012-34-5678", "022-22-2222", "055-55-5555", "077-77-7777", "087-65-4321", "088-88-8888", "098-76-5432",
    "099-99-9999", "100-10-1000", "111-11-1112", "111-11-1234", "111-11-9999", "111-22-1111", "111-22-2333", "111-22-3333",
    "121-21-2121", "123-12-1234", "123-12-3123", "123-45-1234", "123-45-6788", "123-45-6789", "123-45-6798", "123-45-6879",
    "123-45-6987", "123-45-7896", "199-99-9999", "222-33-4444", "299-99-9999", "399-99-9999", "454-54-5454", "499-99-9999",
    "599-99-9999", "699-99-9999", "799-99-9999", "899-99-9999",
)

# Fixed patterns.
TITLE = r"^\s*(mr|mrs|ms|miss|dr|prof|capt|sir|col|gen|cmdr|lt|rabbi|father|brother|sister|hon|honorable|reverend|rev|doctor)\.?\s+"
SUFFIX = r"\s+(jr\.?|junior|sr\.?|senior|I{1,3}|IV|V|VI{0,3}|IX|X|\d+(st|nd|rd|th))$"
LAST_INITIAL = r"\s[^\s]\.?$"
INTEGER = r"^\s*[+-]?\d+\s*$"
DECIMAL = r"^\s*[+-]?(\d+\.\d*|\d*\.\d+|\d+)([eE][+-]?\d+)?\s*$"
YEAR = r"^\s*\d{4}\s*$"
SEX = r"^\s*([Mm](ale)?|[Ff](emale)?)\s*$"
US_POSTAL = r"^\s*(\d{3}|\d{4}|\d{5}(-\d{4})?|\d{9})\s*$"
CA_POSTAL = r"^\s*[A-Za-z]\d[A-Za-z](\s?\d([A-Za-z]\d?)?)?\s*$"
SSN = r"^(?:\d{7,9}(?:[.]0*)?)$|(?:^(?!000|666|9\d\d)(\d{3})-?(?!00)(\d{2})-?(?!0000)(\d{4})$)"


def _real(n: Column) -> Column:
    return (n != "") & ~F.lower(n).isin(*sorted({v.lower() for v in PLACEHOLDERS}))


def first_name(c: Column) -> Column:
    """Letters of the name without title, suffix and last initial; null for what is no name.

    What is cut off always leaves something: a title needs a letter after it, a suffix one before it.
    """
    v = swap(plain(strip(c)), TITLE + r"(?=[^\s])", "", True)
    v = swap(strip(v), SUFFIX, "", True)
    return passing(F.when(_real(c), swap(v, LAST_INITIAL + "|[^a-zA-Z]", "")), _real)


def last_name(c: Column) -> Column:
    """Letters of the name without suffix; null for what is no name. Names of two letters need a vowel or are Ng."""
    v = swap(plain(strip(c)), rf"(?<=[^\s])(?i:{SUFFIX})|[^a-zA-Z]", "")
    long = lambda n: (F.length(n) > 2) | n.rlike("^(?i:[a-z]?[aeiou][a-z]?|ng)$") & (F.length(n) == 2)
    return passing(F.when(_real(c), v), lambda n: long(n) & _real(n))


def _integer(c: Column) -> Column:
    return swap(ascii_digits(strip(c)), r"\A(?:\+?0*|-0*(?=0\z)|(-)0*)(?=\d)", "$1")


def integer(c: Column) -> Column:
    """Any length: sign, then digits without leading zeros; zero has no sign."""
    return F.when(matches(c, INTEGER), _integer(c))


def year(c: Column) -> Column:
    return F.when(matches(c, YEAR), _integer(c))


def decimal(c: Column) -> Column:
    """Shortest digits that give the same double: plain from 1e-4 up to 1e16, else with an exponent of two digits at least."""

    def written(body: Column) -> Column:  # 1.0E10, 1.234E-5, 12.5
        mantissa = F.split_part(body, F.lit("E"), F.lit(1))
        power = F.coalesce(F.regexp_extract(body, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
        whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.rtrim(F.split_part(mantissa, F.lit("."), F.lit(2)), F.lit("0"))
        return let(F.struct(whole.alias("whole"), part.alias("part"), power.alias("power")), lambda x: F.when(x["power"] == 0, body).otherwise(spelled(x["whole"], x["part"], x["power"])))

    def spelled(whole: Column, part: Column, power: Column) -> Column:
        digits, point = F.concat(whole, part), F.length(whole) + power
        rest = F.substring(digits, point + 1, F.length(digits))
        wide = F.concat(F.rpad(digits, point, "0"), F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
        tiny = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), F.rtrim(digits, F.lit("0")))
        size = F.abs(power).cast("string")
        exponent = F.concat(F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(size, F.greatest(F.lit(2), F.length(size)), "0"))
        short = F.concat(whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)), F.lit("e"), exponent)
        return F.when((power > 0) & (power < 16), wide).when((power < 0) & (power >= -4), tiny).otherwise(short)

    def signed(text: Column) -> Column:
        body = F.when(F.ltrim(text, F.lit("-")) == "Infinity", F.lit("inf")).otherwise(written(F.ltrim(text, F.lit("-"))))
        return F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), body)

    def shortest(d: Column) -> Column:  # the engine may write 17 digits where 16 give the same double
        text, rounded = d.cast("string"), F.replace(F.format_string("%.15e", d), F.lit("e+"), F.lit("e"))
        long = F.length(F.translate(F.split_part(text, F.lit("E"), F.lit(1)), "-.", "")) > 16
        return F.when(long & (rounded.try_cast("double") == d), F.upper(rounded)).otherwise(text)

    return F.when(matches(c, DECIMAL), let(let(ascii_digits(strip(c)).try_cast("double"), shortest), signed))


def date(c: Column) -> Column:
    return F.when(matches(c, dates.SHAPE), dates.iso(dates.parse(c)))


def birth_date(c: Column) -> Column:
    day = F.when(matches(c, dates.SHAPE), dates.parse(c))
    return dates.iso(passing(day, lambda d: validators.in_days(d, first="1910-01-01", until_today=True)))


def sex(c: Column) -> Column:
    return F.when(matches(c, SEX), F.when(F.lower(strip(c)).startswith("m"), F.lit("Male")).otherwise(F.lit("Female")))


def us_postal(least: int) -> Callable[[Column], Column]:
    """Five digits. Shorter codes are filled with zeros on the right where they have at least `least` digits."""
    shape = US_POSTAL.replace(r"^\s*", rf"^\s*(?!{'|'.join(US_POSTAL_REJECTED)})")

    def value(c: Column) -> Column:
        five = F.left(strip(c), F.lit(5))
        return F.when(matches(c, shape), F.rpad(five, 5, "0") if least <= 3 else F.when(F.length(five) >= least, F.rpad(five, 5, "0")).otherwise(five))

    return value


def ca_postal(least: int) -> Callable[[Column], Column]:
    """Letter digit letter, blank, digit letter digit. Shorter codes are filled up where they have at least `least` characters."""
    no_area = rf"^({'|'.join(CA_AREAS_REJECTED)}) (000|\d[A-Z]0)$"

    def spelled(u: Column) -> Column:
        size = F.length(u)
        fill = F.when(size == 3, F.lit("000")).when(size == 4, F.lit("A0")).when(size == 5, F.lit("0")).otherwise(F.lit(""))
        return F.when(size >= least, F.concat(F.left(u, F.lit(3)), F.lit(" "), F.substring(u, 4, 3), fill))

    def value(c: Column) -> Column:
        n = F.coalesce(let(F.upper(squeeze_out(c)), spelled), strip(c))
        return passing(F.when(matches(c, CA_POSTAL), n), lambda x: ~F.upper(x).isin(*CA_POSTAL_REJECTED) & ~matches(x, no_area))

    return value


def ssn(c: Column) -> Column:
    """Nine digits with dashes; seven and eight digits are filled up on the left."""
    bare = swap(c, r"[-\s]|\..*", "")
    nine = let(bare, lambda v: F.when(F.length(v) < 9, F.lpad(ascii_digits(v), 9, "0")).otherwise(v))
    return F.when(matches(c, SSN) & ~c.isin(*SSN_REJECTED), F.regexp_replace(nine, "^(...)(..)", "$1-$2-"))


def _type(name: str, value: Callable[[Column], Column], *aliases: str, **more) -> AttributeType:
    return AttributeType(name, (name, *aliases), value, **more)


def _text(c: Column) -> Column:
    return passing(strip(c), lambda v: v != "")


_ALL = [
    _type("String", _text, "Text"),
    _type("RecordId", _text, "Id"),
    _type("Integer", integer),
    _type("Decimal", decimal),
    _type("Date", date, shape=dates.SHAPE),
    _type("Year", year),
    _type("Age", lambda c: passing(integer(c), validators.aged)),
    _type("BirthYear", lambda c: passing(year(c), validators.born), "YearOfBirth"),
    _type("BirthDate", birth_date, settled="TD"),
    _type("Sex", sex, "Gender"),
    _type("FirstName", first_name, "GivenName"),
    _type("LastName", last_name, "Surname"),
    _type("USPostalCode", us_postal(5), "USZipCode"),
    _type("CanadianPostalCode", ca_postal(6), "CanadianZipCode"),
    _type("PostalCode", lambda c: F.coalesce(us_postal(3)(c), ca_postal(3)(c)), "ZipCode", "ZIP3", "ZIP4", "ZIP5"),
    _type("SocialSecurityNumber", ssn, "NationalIdentificationNumber"),
]

TYPES: dict[str, AttributeType] = {t.name: t for t in _ALL}


def combined(name: str, *parts: AttributeType, aliases: tuple[str, ...] = ()) -> AttributeType:
    """Valid if any part is; normalized by the first part that is valid."""
    settled = "".join(s for s in parts[0].settled if all(s in p.settled for p in parts))
    return AttributeType(name, (name, *aliases), lambda c: F.coalesce(*(p.value(c) for p in parts)), settled=settled)


class FieldRegistry:
    """Field ids with their types. Registering gives a new registry; ids are unique."""

    def __init__(self, fields: dict[str, AttributeType] | None = None):
        self.fields = dict(fields or {})

    @classmethod
    def defaults(cls) -> FieldRegistry:
        return cls(TYPES)

    def register(self, field: str, kind: AttributeType | str) -> FieldRegistry:
        if not field or not field.strip():
            raise ValueError("a field id is needed")
        return FieldRegistry(self.fields | {field: TYPES[kind] if isinstance(kind, str) else kind})

    def __getitem__(self, field: str) -> AttributeType:
        if field not in self.fields:
            raise ValueError(f"Unknown field: {field}. Known: {', '.join(sorted(self.fields))}")
        return self.fields[field]

    def __contains__(self, field: str) -> bool:
        return field in self.fields
