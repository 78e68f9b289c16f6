"""Token and match tables in files, bundles, and names of outputs. Paths may be on any file system that Spark reaches."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_COLUMNS = ("RuleId", "Token", "RecordId")
SUFFIX_WORDS = {"tokenize": "_tokenized", "encrypt": "_encrypted", "decrypt": "_decrypted"}


def detect_type(path: str, output: bool = False) -> str:
    """csv or parquet by suffix; outputs may also be zip."""
    kind = os.path.splitext(path)[1].lower().lstrip(".")
    if kind in ("csv", "parquet") or output and kind == "zip":
        return kind
    raise ValueError(f"Unsupported file type: {path}")


def auto_output_path(path: str, command: str) -> str:
    stem, suffix = os.path.splitext(path)
    return f"{stem}_packaged.zip" if command == "package" else f"{stem}{SUFFIX_WORDS[command]}{suffix}"


def metadata_path(path: str) -> str:
    return f"{os.path.splitext(path)[0]}.metadata.json"


def read_tokens(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """RuleId, Token, RecordId as strings; other columns are dropped, null tokens of Parquet files are empty."""
    kind = kind or detect_type(path)
    df = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
    if missing := [c for c in TOKEN_COLUMNS if c not in df.columns]:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TOKEN_COLUMNS))


def write_tokens(tokens: DataFrame, path: str, kind: str | None = None) -> None:
    """A folder of part files: csv with header and \\n line ends, or snappy Parquet."""
    out = tokens.select(*TOKEN_COLUMNS).write.mode("overwrite")
    if (kind or detect_type(path)) == "csv":
        out.options(header=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        out.option("compression", "snappy").parquet(path)


def write_matches(pairs: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Pairs as CSV, with columns renamed where names says so, such as {"A_RecordId": "HospitalRecordId"}."""
    pairs.withColumnsRenamed(names or {}).write.mode("overwrite").option("header", True).csv(path)


def write_single_csv(df: DataFrame, path: str) -> str:
    """One part file, for reports that fit a task; returns the folder."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def _fs(spark: SparkSession, path: str):
    """The file system and the path as the JVM has them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """A small document, such as a run's report."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(content, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def bundle(spark: SparkSession, out: str, *paths: str) -> None:
    """Deflated archive of files, and of the part files of folders under the folder's name. Bytes stream through the JVM."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, where = _fs(spark, out)
    archive = jvm.java.util.zip.ZipOutputStream(fs.create(where, True))

    def add(own, status, name: str) -> None:
        archive.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        source = own.open(status.getPath())
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, archive, conf, False)
        finally:
            source.close()
        archive.closeEntry()

    try:
        for p in paths:
            own, place = _fs(spark, p)
            if own.getFileStatus(place).isDirectory():
                for status in sorted(own.listStatus(place), key=lambda s: s.getPath().getName()):
                    if not status.getPath().getName().startswith((".", "_")):
                        add(own, status, f"{place.getName()}/{status.getPath().getName()}")
            else:
                add(own, own.getFileStatus(place), place.getName())
    finally:
        archive.close()
