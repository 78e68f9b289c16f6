"""MinHash near-duplicate detection with exact confirmation.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one class, led by the
   smallest id, so that copies cost nothing further.
2. Leaders get minima of N_HASHES universal hashes, cut into bands; equal bands put leaders into a bucket.
3. Links are looked for in rounds, and components that are known cut the work. First every leader is held against the
   least leader it meets in any bucket. Then, in buckets that hold leaders of different components, the leaders outside
   the bucket's largest component are held, in blocks of fixed size, and the bucket's members stream past them: while
   that finds enough, each held leader proposes the few members of other components whose minima agree most; the last
   round takes every pair of different components whose minima allow a link. Pairs are confirmed on the full sets;
   leaders that very many others resemble are compared on full sets where they are held.
4. Components of the confirmed links come from alternating large-star and small-star.

Bands follow from the threshold: a pair at it meets in no bucket with a chance of at most 4e-5 (26 bands of 5 at 0.8),
and nearer pairs less. Null texts and texts without words have an empty set and are linked with nothing. Repeated rows of
one id are one document and give one result each; where their texts differ, all of these texts are in one component, and
where the id leads several of them, links are looked for on the one with the least set hash. Texts of any length are read
whole. An empty table gives an empty result. Null ids, and ids that are no whole number, are kept, unlinked and with a null component. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from functools import cache
from itertools import accumulate
from math import comb, log

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushjoin.llm.common import CACHES, WORD, Scratch, join_hot, map_columns, scratch_scope
from hushjoin.llm.components import components

N_HASHES = 130
SEED = 20240607
#: Chances that a pair at the threshold meets in no bucket, and that its minima rule it out.
MISSED, RULED_OUT = 4e-5, 1e-6
#: Held leaders and streaming members of one task and bucket.
HELD_ROWS, STREAM_ROWS = 2048, 16_384
#: Proposals of a held leader in a task, and the share of them that must be links for another such round.
PROPOSALS, WORTH = 3, 0.05
HELD_SHINGLES = 1 << 21
#: A held leader with more possible partners than this in a task is compared on full sets, without writing pairs.
CROWD = 64
PAIRS_PER_CENTRE = 256
MAX_BROADCAST_IDS = 200_000
MEMO = 150_000

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_A = np.random.RandomState(SEED).randint(0, 1 << 31, size=(N_HASHES, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)


@cache
def banding(percent: int) -> tuple[int, int, int]:
    """Bands, minima a band, and the fewest equal minima of a link, for a threshold. 26, 5 and 81 at 80.

    Bands are as wide as MISSED allows. ValueError for thresholds that N_HASHES minima cannot serve.
    """
    t = percent / 100
    wide = [r for r in range(1, N_HASHES + 1) if 0 < t <= 1 and (1 - t**r) ** (N_HASHES // r) <= MISSED]
    if not wide:
        raise ValueError(f"{N_HASHES} minima find no pairs of {percent} percent")
    below = accumulate(comb(N_HASHES, m) * t**m * (1 - t) ** (N_HASHES - m) for m in range(N_HASHES))
    return N_HASHES // wide[-1], wide[-1], sum(p <= RULED_OUT for p in below)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.translate(_UPPER))
        return h


_words = _WordHash()
CACHES.append(_words)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of the whole sequence if it has fewer words."""
    found = WORD.findall(text) if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(shingles: np.ndarray) -> bytes:
    """N_HASHES minima of multiplicative universal hashes (odd factors, modulo 2**32) of the shingles' upper halves."""
    low = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    for at in range(0, x.shape[1], 2048):
        low = np.minimum(low, (x[:, at : at + 2048] * _A).min(axis=1))
    return low.astype("<u4").tobytes()


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"try_cast(`{id_col}` as long) AS id", f"`{text_col}` AS text")


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_hash (of the whole set, null if empty) and minima (null if empty)."""

    def start():
        def mapper(cols):
            n, digest, sig = [], [], []
            for text in cols["text"]:
                s = shingle_set(text, size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minima(s) if len(s) else None)
            return {"id": cols["id"], "n_shingles": n, "set_hash": digest, "minima": sig}

        return mapper

    return map_columns(_plain(docs, id_col, text_col), start, "id long, n_shingles long, set_hash binary, minima binary")


def buckets_of(leaders: DataFrame, percent: int) -> DataFrame:
    """bucket (64-bit key of band and its minima) and id, for each band."""
    bands, rows, _ = banding(percent)
    part = lambda b: F.substring("minima", b * (4 * rows) + 1, F.lit(4 * rows))
    return leaders.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, part(b)))).alias("bucket"))


def _close(pairs: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose sizes allow the threshold and whose minima agree often enough."""
    least = banding(percent)[2]

    def start():
        def mapper(cols):
            ma, mb = (np.frombuffer(b"".join(cols[c]), "<u4").reshape(-1, N_HASHES) for c in ("ma", "mb"))
            near = np.flatnonzero((ma == mb).sum(axis=1) >= least).tolist()
            return {k: [cols[k][i] for i in near] for k in ("a", "b")}

        return mapper

    left = leaders.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("minima").alias("ma"))
    right = leaders.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("minima").alias("mb"))
    both = pairs.join(right, "b").join(left, "a").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return map_columns(both.select("a", "b", "ma", "mb"), start, "a long, b long")


class _Stream:
    """Held leaders of one (bucket, part, block, chunk), and members that stream past them. Modes:

    propose: a held leader's few best members of other components.
    all: every member whose minima allow a link; a held leader with more than CROWD of them is only named (b null).
    exact: full sets are compared here; pairs that join two components not yet joined in this task.
    """

    def __init__(self, mode: str, percent: int):
        self.mode, self.percent, self.key = mode, percent, None
        self.least = banding(percent)[2]
        self.clear()

    def clear(self) -> None:
        self.ids, self.comps, self.sizes, self.minima, self.sets, self.best = [], [], [], [], [], []
        self.table, self.root = None, {}

    def find(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            c = up
        return c

    def close(self, out: dict) -> None:
        for a, found in zip(self.ids, self.best):
            if self.mode == "all" and len(found) > CROWD:
                found = [(0, None)]
            for _, b in found:
                out["a"].append(a if b is None else min(a, b))
                out["b"].append(None if b is None else max(a, b))
                out["bucket"].append(self.key[0])

    def take(self, key, role, i, c, n, raw, out: dict) -> None:
        if key != self.key:
            self.close(out)
            self.clear()
            self.key = key
        m = np.frombuffer(raw, "<u4", N_HASHES)
        if role == 0:
            self.ids.append(i)
            self.comps.append(c)
            self.sizes.append(n)
            self.minima.append(m)
            self.best.append([])
            if self.mode == "exact":
                self.sets.append(np.frombuffer(raw, np.uint64, offset=4 * N_HASHES))
            return
        if self.table is None:
            self.table = (np.array(self.comps), np.array(self.sizes), np.array(self.minima))
        comps, sizes, minima = self.table
        other = np.flatnonzero((comps != c) & (100 * np.minimum(sizes, n) >= self.percent * np.maximum(sizes, n)))
        if not len(other):
            return
        equal = (minima[other] == m).sum(axis=1)
        near = equal >= self.least
        for k, e in zip(other[near].tolist(), equal[near].tolist()):
            best = self.best[k]
            if self.mode == "all":
                if len(best) <= CROWD:
                    best.append((e, i))
            elif self.mode == "propose":
                (heapq.heappush if len(best) < PROPOSALS else heapq.heappushpop)(best, (e, i))
            elif (one := self.find(self.comps[k])) != (two := self.find(c)):
                own, theirs = self.sets[k], np.frombuffer(raw, np.uint64, offset=4 * N_HASHES)
                both = len(np.intersect1d(own, theirs, assume_unique=True))
                if 100 * both >= self.percent * (len(own) + len(theirs) - both):
                    self.root[max(one, two)] = min(one, two)
                    best.append((e, i))


def _by_size(held: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """held and rows with a column part. In large buckets it is the size class of a set; a row goes to its own class and to both beside
    it, since sizes of a link differ by a class at most. Elsewhere it is 0."""
    width = max(-log(percent / 100), 1e-3) * (1 + 1e-9)
    own = F.floor(F.log("n_shingles") / width).cast("int") + 1
    near = F.when(F.col("large"), F.array(own - 1, own, own + 1)).otherwise(F.array(F.lit(0)))
    return held.withColumn("part", F.when(F.col("large"), own).otherwise(F.lit(0))), rows.withColumn("part", F.explode(near))


def _streamed(held: DataFrame, rows: DataFrame, total: int, mode: str, percent: int) -> DataFrame:
    """Distinct a, b, bucket of held leaders against the rows of their buckets: columns bucket, large, id, c, n_shingles, payload.

    Blocks bound the held rows and shingles of a task, chunks the rows that stream through it. total: number of rows.
    """
    held, rows = _by_size(held, rows, percent)
    key = ["bucket", "part"]
    size = F.greatest(F.ceil(F.count("*") / HELD_ROWS), F.ceil(F.sum("n_shingles") / HELD_SHINGLES)).cast("int")
    blocks = held.groupBy(*key).agg(size.alias("blocks"))
    chunks = rows.groupBy(*key).agg(F.ceil(F.count("*") / STREAM_ROWS).cast("int").alias("chunks"), F.count("*").alias("n"))
    deal = blocks.join(chunks, key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    kept = join_hot(held, deal, key, 3 * total, "id").withColumn("block", own("blocks")).withColumn("chunk", every("chunks")).withColumn("role", F.lit(0))
    passing = join_hot(rows, deal, key, 3 * total, "id").withColumn("chunk", own("chunks")).withColumn("block", every("blocks")).withColumn("role", F.lit(1))
    cols = [*key, "block", "chunk", "role", "id", "c", "n_shingles", "payload"]
    dealt = kept.select(*cols).union(passing.select(*cols)).repartition(*cols[:4]).sortWithinPartitions(*cols[:6])

    def start():
        stream = _Stream(mode, percent)

        def mapper(cols):
            out = {"a": [], "b": [], "bucket": []}
            for *cell, role, i, c, n, raw in zip(*cols.values()):
                stream.take(tuple(cell), role, i, c, n, raw, out)
            return out

        def last():
            out = {"a": [], "b": [], "bucket": []}
            stream.close(out)
            return out

        mapper.last = last
        return mapper

    return map_columns(dealt, start, "a long, b long, bucket long")


def _open_rows(buckets: DataFrame, total: int, label: DataFrame, leaders: DataFrame) -> DataFrame:
    """Rows of buckets that span components: bucket, large (over HELD_ROWS rows), id, c (component), main (the bucket's largest), n_shingles, minima."""
    marked = buckets.join(label, buckets.id == label.node, "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    parts = marked.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    state = parts.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("n")).filter("parts > 1")
    state = state.select("bucket", F.col("top.c").alias("main"), (F.col("n") > HELD_ROWS).alias("large"), "n")
    return join_hot(marked, state, "bucket", total, "id").join(leaders, "id").select("bucket", "large", "id", "c", "main", "n_shingles", "minima")


def _sets(docs: DataFrame, wanted: DataFrame, leaders: DataFrame, size: int) -> DataFrame:
    """id and shingles (binary) of the leaders whose id is wanted (each once); only those texts are read into sets."""
    ids = leaders.select("id", "set_hash").join(wanted, "id")
    ids = F.broadcast(ids) if wanted.count() <= MAX_BROADCAST_IDS else ids

    def start():
        def mapper(cols):
            sets = [shingle_set(t, size).tobytes() for t in cols["text"]]
            mine = [n for n, (s, h) in enumerate(zip(sets, cols["set_hash"])) if xxhash.xxh3_128_digest(s) == h]
            return {"id": [cols["id"][n] for n in mine], "shingles": [sets[n] for n in mine]}

        return mapper

    return map_columns(docs.join(ids, "id"), start, "id long, shingles binary").dropDuplicates(["id"])


def _links_in_crowds(crowded: DataFrame, rows: DataFrame, total: int, docs: DataFrame, leaders: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links of leaders that very many members of a bucket resemble, found on full sets without writing pairs."""
    there = rows.join(crowded.select("bucket").distinct(), "bucket", "left_semi")
    sets = scratch.write(_sets(docs, there.select("id").distinct(), leaders, size))
    full = scratch.write(there.join(sets, "id").select("bucket", "large", "id", "c", "n_shingles", F.concat("minima", "shingles").alias("payload")))
    held = full.join(crowded, ["bucket", "id"], "left_semi")
    out = scratch.write(_streamed(held, full, total, "exact", percent).select("a", "b").distinct())
    scratch.drop(sets, full)
    return out


def _confirmed(pairs: DataFrame, docs: DataFrame, leaders: DataFrame, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs whose full sets overlap enough, and the sets. Only documents of pairs are read again.

    Rows are sorted by centre, the centre's set first, and stream through a task that holds one set at a time.
    A centre with many partners is copied to a number of groups that follows from their count.
    """
    ids = scratch.write(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = scratch.write(_sets(docs, ids, leaders, size))
    spread = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {PAIRS_PER_CENTRE}) as int)").alias("groups"))
    members = pairs.join(spread, "a").withColumn("g", F.expr("pmod(xxhash64(b), groups)").cast("int"))
    members = members.join(sets, members.b == sets.id).select("a", "g", "b", "shingles")
    centres = spread.join(sets, spread.a == sets.id).select("a", F.explode(F.expr("sequence(0, groups - 1)")).alias("g"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = centres.union(members).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def start():
        held = [None, None]

        def mapper(cols):
            out = {"a": [], "b": []}
            for a, g, b, raw in zip(cols["a"], cols["g"], cols["b"], cols["shingles"]):
                s = np.frombuffer(raw, np.uint64)
                if b is None:
                    held[:] = [a, s.copy()]
                    continue
                assert held[0] == a
                both = len(np.intersect1d(held[1], s, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(held[1]) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return mapper

    return scratch.write(map_columns(rows, start, "a long, b long")), sets


def _same_ids(full: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """u, v: the leaders of all classes that one id is in, linked to the least of them. None if no id has two texts."""
    mark = F.xxhash64("set_hash")
    several = scratch.write(full.groupBy("id").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).filter("x < y").select("id"))
    if several.isEmpty():
        return None
    met = full.join(several, "id").select("id", "set_hash").distinct().join(classes.select("set_hash", "leader"), "set_hash")
    return met.join(met.groupBy("id").agg(F.min("leader").alias("v")), "id").select(F.col("leader").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row of docs (other columns are ignored)."""
    kept = Scratch(docs.sparkSession)
    with scratch_scope():
        return kept.write(_near_duplicates(docs, size, percent, id_col, text_col, Scratch(docs.sparkSession)))


def _near_duplicates(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    texts = _plain(docs, id_col, text_col)
    sig = scratch.write(signatures(docs, size, id_col, text_col))
    full = sig.filter("set_hash is not null and id is not null")
    lead = F.min_by(F.struct("n_shingles", "minima"), "id").alias("lead")
    grouped = full.groupBy("set_hash").agg(F.min("id").alias("leader"), F.count("*").alias("n"), lead)
    classes = scratch.write(grouped.select("set_hash", "leader", "n", "lead.*"))
    # an id leads several classes only where its rows have different texts: the one with the least hash stands for it
    first = classes.groupBy(F.col("leader").alias("id")).agg(F.min_by(F.struct("set_hash", "n_shingles", "minima"), "set_hash").alias("lead"))
    leaders = scratch.write(first.select("id", "lead.*"))
    rows = buckets_of(leaders, percent)
    shared = rows.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.write(join_hot(rows, shared, "bucket", banding(percent)[0] * leaders.count(), "id").select("bucket", "id", "first"))
    met = buckets.count()

    # every leader against the least leader it meets in any bucket
    near = scratch.write(_close(buckets.groupBy(F.col("id").alias("b")).agg(F.min("first").alias("a")).filter("a < b"), leaders, percent))
    found, sets = _confirmed(near, texts, leaders, size, percent, scratch)
    scratch.drop(near, sets)
    links = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if (same := _same_ids(full, classes, scratch)) is not None:
        links = links.union(same)
    label = components(links, scratch)
    buckets = buckets.select("bucket", "id")
    mode = "propose"
    while True:
        rows = scratch.write(_open_rows(buckets, met, label, leaders))
        total = rows.count()
        if not total:
            break
        plain = rows.withColumnRenamed("minima", "payload")
        seen = scratch.write(_streamed(plain.filter("c <> main"), plain, total, mode, percent).distinct())
        pairs = scratch.write(seen.filter("b is not null").select("a", "b").distinct())
        found, sets = _confirmed(pairs, texts, leaders, size, percent, scratch)
        tried, linked = pairs.count(), found.count()
        scratch.drop(pairs, sets)
        crowded = seen.filter("b is null").select("bucket", F.col("a").alias("id"))
        if mode == "all" and not crowded.isEmpty():
            found = found.union(_links_in_crowds(crowded, rows, total, texts, leaders, size, percent, scratch))
        scratch.drop(rows)
        if linked or mode == "all":
            links = label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
            label = components(links, scratch)
        if mode == "all":
            break  # every pair of a bucket is now in one component or tried
        mode = "propose" if linked > WORTH * tried else "all"
    found = classes.join(label, classes.leader == label.node, "left").select("set_hash", F.coalesce("component", "leader").alias("c"), "n")
    found = scratch.write(found)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # rows without an id have no component, and those of an empty set only their own: neither meets a class
    members = join_hot(full.select("set_hash", "id", "n_shingles"), found, "set_hash", total, "id")
    rest = sig.filter("set_hash is null or id is null").select("id", "n_shingles", F.col("id").alias("c"))
    out = members.select("id", "n_shingles", "c").union(rest).withColumnRenamed("c", "component_id")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.withColumn("kept", kept).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that lead their component, with their own columns. All rows of an id that stays do, as do rows with a null id."""
    gone = near_duplicates(docs, size, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")  # the same plan at every size
