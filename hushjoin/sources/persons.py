"""Person sources: readers that map columns by alias to canonical fields, all as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a person by default, and what a table must have for the default rules.
DEFAULT_FIELDS = ("RecordId", "FirstName", "LastName", "BirthDate", "Sex", "PostalCode", "SocialSecurityNumber")


def aliases_of(field: str, registry) -> tuple[str, ...]:
    names = registry[field].aliases if field in registry else ()
    extra = ("DateOfBirth",) if field == "BirthDate" else ()
    return tuple(dict.fromkeys((field, *names, *extra)))


def find_column(columns: list[str], names: tuple[str, ...], ignore_case: bool = False) -> str | None:
    """The first alias that is there (or, ignoring case, the last column that is an alias)."""
    if ignore_case:
        low = {n.lower() for n in names}
        hits = [c for c in columns if c.lower() in low]
        return hits[-1] if hits else None
    return next((n for n in names if n in columns), None)


def record_id(df: DataFrame, registry, ignore_case: bool = False) -> Column:
    """The id column as a string; a random UUID for each row where the table has none."""
    c = find_column(df.columns, aliases_of("RecordId", registry), ignore_case)
    return F.col(f"`{c}`").cast("string") if c else F.uuid()


def resolve_columns(df: DataFrame, fields: list[str], registry) -> DataFrame:
    """RecordId and __raw_<field> for each field that has a column. Other columns are pruned."""
    chosen = [record_id(df, registry).alias("RecordId")]
    for f in fields:
        c = find_column(df.columns, aliases_of(f, registry))
        if c:
            chosen.append(F.col(f"`{c}`").cast("string").alias(f"__raw_{f}"))
    return df.select(*chosen)


def require_columns(df: DataFrame, registry, fields=DEFAULT_FIELDS[1:]) -> None:
    """ValueError that lists the alias groups that are missing."""
    missing = ["/".join(aliases_of(f, registry)) for f in fields if find_column(df.columns, aliases_of(f, registry)) is None]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def canonical(df: DataFrame, registry, mapping: dict[str, str] | None = None, ignore_case: bool = True) -> DataFrame:
    """Known columns under their field names, all as strings, null as the empty text; unknown ones are dropped. mapping: field to column."""
    out = {}
    if mapping:
        for f, c in mapping.items():
            hit = next((x for x in df.columns if x == c), None) or next((x for x in df.columns if x.lower() == c.lower()), None)
            if hit:
                out[f] = F.col(f"`{hit}`").cast("string")
    else:
        for f in registry.fields:
            c = find_column(df.columns, aliases_of(f, registry), ignore_case)
            if c:
                out[f] = F.col(f"`{c}`").cast("string")
    if "RecordId" not in out:
        out["RecordId"] = F.uuid()
    return df.select(*((c if f == "RecordId" else F.coalesce(c, F.lit(""))).alias(f) for f, c in out.items()))


def read_persons(spark: SparkSession, path: str, registry, kind: str = "parquet", mapping: dict[str, str] | None = None) -> DataFrame:
    """kind: csv (header row, UTF-8; an empty cell is null) or parquet."""
    if kind == "csv":
        df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"Unsupported file type: {kind}")
    return canonical(df, registry, mapping)
