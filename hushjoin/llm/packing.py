"""Best-fit packing of tokenized documents into fixed-length sequences.

Online best-fit in bounded space: each task keeps at most OPEN_BINS open bins, indexed by a bitset keyed by
free space. A piece goes to the open bin with the least space that still holds it; when all bins are taken
and none fits, the fullest is closed for good. Null texts count as empty: such a document is the one end id.
Repeated rows are packed once each. Texts of any length are encoded whole. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushjoin.llm.common import CACHES, WORD, Scratch, map_columns, trim, worker_threads
from hushjoin.llm.token_counts import byte_alphabet

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 512
PIECES_PER_TASK = 1 << 17
#: Words and units that a worker keeps at most; under the size at which a dict of 2**20 places doubles.
MEMO = 690_000

_encoders: dict = {}

#: Words that are one run of Latin-1 letters and ASCII marks after it: each part is one unit of the tokenizer.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{}~|]*)")


# The normalizer and the first splitting of tokenizer files whose texts may be encoded word by word.
_BY_WORD = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)


def by_word(path: str) -> bool:
    """Whether the tokenizer of this file lower-cases, splits words into letters and marks, and merges nothing across them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = ((spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers"))
    marked = all(t["content"].startswith("<|") for t in spec.get("added_tokens", ()))
    return steps == _BY_WORD and marked and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and spec.get("post_processor") is None


class WordIds(dict):
    """Word to its token ids, little-endian unsigned 32-bit, for tokenizers that allow it; others encode whole texts.

    Most words are a run of letters with marks after it, which are two units of the tokenizer; any other word goes
    to the tokenizer as it is. Units are kept beside words: a unit alone is a word with the same ids. What is kept is
    bounded: it is emptied at a fixed size.
    """

    def __init__(self, path: str, parted: bool):
        super().__init__()
        worker_threads()
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), parted
        self.merge = self.tokenizer.model.tokenize
        back = {b: c for c, b in byte_alphabet().items()}
        self.spelled = {i: "".join(back[b] for b in chr(i).encode()) for i in range(0x80, 0x100)}
        trim()  # reading the file takes more memory than the tokenizer

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        m = _PLAIN.fullmatch(word.lower())
        if m and "<|" not in word:
            letters, marks = m.groups()
            ids = self.unit(word if letters == word else letters) + self.unit(marks)
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def unit(self, unit: str) -> bytes:
        """Ids of letters or of marks, by the merges alone."""
        ids = self.get(unit)
        if ids is None:
            ids = self[unit] = array("I", [t.id for t in self.merge(unit.translate(self.spelled))]).tobytes() if unit else b""
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, WORD.findall(text))) if self.by_word else self.whole(text)


def encoder(path: str, parted: bool) -> WordIds:
    if path not in _encoders:
        made = _encoders[path] = WordIds(path, parted)
        CACHES.append(made)
    return _encoders[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, and the ids themselves (binary) if asked for."""
    width, parted = 4 * capacity, by_word(tokenizer_path)

    def start():
        encode = encoder(tokenizer_path, parted).encode
        end = array("I", [END_ID]).tobytes()

        def mapper(cols):
            out = {k: [] for k in (id_col, "piece", "start", "length", "ids_crc32", "ids")}
            texts = [t or "" for t in cols["text"]]
            for doc, text in zip(cols[id_col], texts):
                ids = encode(text) + end
                for n, low in enumerate(range(0, len(ids), width)):
                    part = ids[low : low + width]
                    out[id_col].append(doc)
                    out["piece"].append(n)
                    out["start"].append(low // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(part if with_ids else None)
            return out

        return mapper

    src = docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text")
    kind = src.schema[id_col].dataType.simpleString()
    out = map_columns(src, start, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


class OpenBins:
    """Open bins by free space. A set bit f of the bitset says that some open bin has f places free."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def put(self, length: int) -> tuple[int, int]:
        """Bin number and offset for a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bins = self.by_free[free]
            number = bins.pop()
            if not bins:
                self.bits ^= 1 << free
            self.count -= 1
        else:
            if self.count >= self.limit:
                self.close_fullest()
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        bins = self.by_free[free]
        bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int | None = None, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces that have a length of 1 to capacity.

    Pieces are dealt by a hash of their keys and read in a fixed order, so that a task that runs again after
    an executor is lost gives the same sequences. Each task leaves at most open_bins unfilled sequences.
    """
    if tasks is None:
        tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    schema = StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def run(batches):
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            placed = [bins.put(n) for n in lengths]
            seq = pa.array([base + b for b, _ in placed], pa.int64())
            off = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, seq, off], names=[*batch.schema.names, "sequence_id", "offset"])

    order = [F.xxhash64(*keys), *keys]
    return pieces.repartition(tasks, *keys).sortWithinPartitions(*order).mapInArrow(run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack all documents; one row a piece, with its place. Texts are encoded once, into a table of pieces."""
    pieces = Scratch(spark).write(cut_pieces(docs, tokenizer_path, capacity))
    return pack(pieces, capacity, open_bins)


def sequences(pieces_with_ids: DataFrame, placed: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The packed token ids: one row a sequence with its ids (binary). A sequence holds at most capacity ids."""
    both = pieces_with_ids.select(*keys, "ids").join(placed.select(*keys, "sequence_id", "offset"), list(keys))
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")
