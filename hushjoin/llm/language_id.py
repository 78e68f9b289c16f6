"""Language identification by compression.

For each language raw-content zstandard dictionaries are made of sampled training texts, which are learned whole: at most
SAMPLE_TEXTS texts a language, fewer where there are so many languages that SAMPLE_ROWS would be passed. A language whose
texts are longer than DICTIONARY_BYTES has several dictionaries, and the one that compresses best speaks for it. A text, in
lower case, is compressed in pieces against every dictionary, and the language with the fewest bytes in all wins. Where the
margin to the second is narrow (RECHECK), the bytes of its distinct words, each compressed alone, are added; ties then go
to the language name that sorts first, and rows whose margin is still narrow (NARROW) are marked as rejected.

Null texts and texts without a letter are und, with score 0. Without any training language every text is und.
Languages of the training rows are taken as they are; null ones are not learned. More than SAMPLE_ROWS languages raise
ValueError. Repeated rows are judged alike. Rows with a null id are judged, never held out and never learned from. Texts of
any length are read whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushjoin.llm.common import crc_mod, map_columns

PARTS, HELD_OUT = 3, 1
#: Bounds of the training sample: texts a language, and texts in all.
SAMPLE_TEXTS, SAMPLE_ROWS = 160, 10_000
DICTIONARY_BYTES = 2 << 20
PIECE_BYTES = 2_048
LEVEL = 9
NARROW, RECHECK = 0.01, 0.03
MAX_BROADCAST_LANGS = 10_000
UND = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def sample_texts(docs: DataFrame) -> dict[str, bytes]:
    """For each language its sampled training texts, those with the least hash of the id, in lower case."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.filter((crc_mod("id", PARTS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = found.count()
    if not langs:
        return {}
    if langs > SAMPLE_ROWS:
        raise ValueError(f"{langs} languages, {SAMPLE_ROWS} at most")
    each = min(SAMPLE_TEXTS, SAMPLE_ROWS // langs)
    found = F.broadcast(found) if langs <= MAX_BROADCAST_LANGS else found
    # about twice as many as wanted pass the share, which is cut exactly after the least hashes of all have been taken
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)).alias("share")
    near = rows.join(found, "lang").select("lang", "id", "text", share, "n").filter(f"share < 1000000 * {2 * each + 20} / n").drop("n")
    got = near.orderBy("share", "id", "lang", "text").limit(2 * (2 * each + 20) * langs).toPandas()
    out = {}
    for lang, part in got.groupby("lang"):
        texts = part.sort_values(["share", "id", "text"])["text"].head(each)
        out[str(lang)] = b"\n".join(t.lower().encode("utf-8", "surrogatepass") for t in texts)
    return out


class Judge:
    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        self.compress = [[self._compressor(texts[x][i : i + DICTIONARY_BYTES]) for i in range(0, max(1, len(texts[x])), DICTIONARY_BYTES)] for x in self.langs]

    @staticmethod
    def _compressor(content: bytes):
        params = dict(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        if len(content) < 8:  # too short for a dictionary
            return zstandard.ZstdCompressor(**params).compress
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, **params).compress

    def bytes_of(self, parts) -> list[int]:
        """Compressed bytes of all parts, by language."""
        return [min(sum(len(c(p)) for p in parts) for c in own) for own in self.compress]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow."""
        if not text or not self.langs or not has_letter(text):
            return UND, 0.0, True
        raw = text.lower().encode("utf-8", "surrogatepass")
        sizes = self.bytes_of([raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)])
        if self.margin(sizes) < RECHECK:
            sizes = [n + m for n, m in zip(sizes, self.bytes_of({b" " + w + b" " for w in raw.split()}))]
        margin = self.margin(sizes)
        return self.langs[sizes.index(min(sizes))], 1 - math.exp(-margin / 0.02), margin < NARROW

    @staticmethod
    def margin(sizes: list[int]) -> float:
        """What the best saves against the second, as a share of the second; 1 without a second."""
        first, *rest = sorted(sizes)
        return (rest[0] - first) / rest[0] if rest else 1.0


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (narrow margin) of every document."""
    texts = docs.sparkSession.sparkContext.broadcast(sample_texts(docs))  # at most SAMPLE_ROWS texts
    src = docs.select("doc_id", "text")

    def start():
        judge = Judge(texts.value)

        def mapper(cols):
            found = [judge(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

        return mapper

    kind = src.schema["doc_id"].dataType.simpleString()
    out = map_columns(src, start, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    held = F.coalesce(crc_mod("doc_id", PARTS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
