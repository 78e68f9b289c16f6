"""URL filtering by a sorted digest array.

Rules are strings of host and path. The array of their 64-bit xxhash keys is sorted and kept in a file that each
executor maps into memory; a url's candidates (each suffix of its host at a label, with each path length that
rules have) are hashed, looked up by vectorised binary search, and confirmed on the stored strings, so that equal
keys of different strings cannot mislead. The longest rule that fits decides; without one the verdict is allow.

Rules without a slash mean every path of their host. Null urls and urls without "://" have an empty host and path and no
rule. Urls of any length are judged whole, and repeated rows alike. Extra columns are ignored, whatever their names. An
empty table gives an empty result; without rules every url is allowed.
"""

from __future__ import annotations

import os
import re
from hashlib import sha256

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from hushjoin.llm.common import map_columns, shared_dir

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEFAULT = "allow"

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.match(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def digest_file(rules) -> bytes:
    """Layout, all little-endian: count n, number of path lengths m; m lengths; n sorted keys; n+1 offsets; n verdicts
    (1: block), as 64-bit words; then the strings, in key order."""
    by_string = {r if "/" in r else f"{r}/": v for v, r in rules}
    keyed = sorted((xxhash.xxh64_intdigest(r), r) for r in by_string)
    lengths = sorted({len(r) - r.index("/") for r in by_string})
    raw = [r.encode() for _, r in keyed]
    off = np.cumsum([0, *map(len, raw)])
    words = [len(keyed), len(lengths), *lengths, *(k for k, _ in keyed), *off.tolist(), *(int(by_string[r] == "block") for _, r in keyed)]
    return np.array(words, "<u8").tobytes() + b"".join(raw)


class Digests:
    """A mapped digest file."""

    def __init__(self, path: str):
        self.words = np.memmap(path, "<u8", "r", shape=(os.path.getsize(path) // 8,))
        n, m = int(self.words[0]), int(self.words[1])
        self.lengths = self.words[2 : 2 + m].tolist()
        at = 2 + m
        self.keys, self.offsets, self.block = self.words[at : at + n], self.words[at + n : at + 2 * n + 1], self.words[at + 2 * n + 1 : at + 3 * n + 1]
        self.strings = np.memmap(path, "u1", "r", offset=8 * (at + 3 * n + 1)) if n else None

    def string(self, i: int) -> str:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes().decode()

    def find(self, wanted: list[str]) -> list[int]:
        """Place of each string, -1 if it is not held."""
        out = np.full(len(wanted), -1, np.int64)
        if len(self.keys) and wanted:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, wanted), np.uint64, len(wanted))
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            for i in np.flatnonzero(self.keys[at] == keys).tolist():
                p = int(at[i])
                while p < len(self.keys) and self.keys[p] == keys[i]:  # equal keys stand together
                    if self.string(p) == wanted[i]:
                        out[i] = p
                        break
                    p += 1
        return out.tolist()


def judge(digests: Digests, urls: list[str | None]) -> dict[str, list]:
    hosts, paths, wanted, owner = [], [], [], []
    for n, url in enumerate(urls):
        host, path = split_url(url)
        hosts.append(host)
        paths.append(path)
        heads = [path[:k] for k in digests.lengths if k <= len(path)]
        if heads and host:
            labels = host.split(".")
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                for head in heads:
                    wanted.append(suffix + head)
                    owner.append(n)
    rule: list[str | None] = [None] * len(urls)
    verdict = [DEFAULT] * len(urls)
    for n, text, p in zip(owner, wanted, digests.find(wanted)):
        if p >= 0 and (rule[n] is None or (len(text), text) > (len(rule[n]), rule[n])):
            rule[n], verdict[n] = text, "block" if digests.block[p] else "allow"
    return {"host": hosts, "path": paths, "rule": rule, "verdict": verdict}


def ship(spark: SparkSession, rules) -> str:
    """Write the digest file to the shared folder and have Spark bring it to every executor; its name there.

    Names follow from content: the same rules are written and shipped once a session.
    """
    content = digest_file(rules)
    name = f"digests-{sha256(content).hexdigest()[:32]}.bin"
    if any(str(f).endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        return name
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(conf).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toUri().toString() if path.toUri().getScheme() else f"file://{path}")
    return name


_open: dict[str, Digests] = {}


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null: none) and verdict of every row. Rules: (allow or block, host/path)."""
    name = ship(pages.sparkSession, rules)

    def start():
        if name not in _open:
            _open.clear()  # a worker maps the rules of one call at a time
            _open[name] = Digests(SparkFiles.get(name))
        return lambda cols: {id_col: cols[id_col]} | judge(_open[name], cols["url"])

    src = pages.selectExpr(f"`{id_col}`", f"`{url_col}` AS url")
    kind = src.schema[id_col].dataType.simpleString()
    return map_columns(src, start, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


SQL = """
WITH p AS (
  SELECT page_id, url, strpos(url, '://') AS k FROM pages
), r AS (
  SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM p
), h AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), u AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h
), x AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM x
"""
