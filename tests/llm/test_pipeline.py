"""The pipeline stage by stage, and the registered queries with SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushjoin.llm import common, features, quality_classifier
from hushjoin.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def norm(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(None if x is None or x != x else x for x in r) for r in df[cols].itertuples(index=False)), key=repr)


# ---- plain versions of the stages: rows in, rows out, nothing of the operators' tables, sketches and windows


def words_in(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_good(rows, model):
    """The classifier's model, applied text by text to all marks."""
    full, out = features.Marks(), []
    for r in rows:
        words, counts = features.words_of(r.text)
        marks = set(full.of(counts, len(words)).tolist())
        style = [float(v > e) for v, edges in zip(features.style_of(r.text, words, counts), model.edges) for e in edges]
        if np.dot(style + [float(c in marks) for c in model.columns.tolist()], model.weights) >= model.cut:
            out.append(r)
    return out


def plain_rules(rows):
    failed, hosts = {}, defaultdict(list)
    for n, r in enumerate(rows):
        w = words_in(r.text)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {p for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
        failed[n] = len(w) < 50 or len(hit) * 100 > 50 * len(w)
        if r.source is not None:
            hosts[r.source].append(failed[n])
    rates = [sum(f) / len(f) for f in hosts.values()]
    m = sum(rates) / len(rates) if rates else 0
    v = sum((x - m) ** 2 for x in rates) / len(rates) if rates else 0
    prior = m * (1 - m) / v - 1 if v > 0 and m * (1 - m) > v else 1
    bad = {h for h, f in hosts.items() if (sum(f) + m * prior) / (len(f) + prior) > 0.8}
    return [r for n, r in enumerate(rows) if not failed[n] and r.source not in bad]


def plain_dedup(rows):
    """Every pair of sets of five-word shingles."""
    sets, comp = {}, {}
    for r in rows:
        w = words_in("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        comp[r.doc_id] = r.doc_id
    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                one, two = sorted((comp[x], comp[y]))
                comp = {i: one if c == two else c for i, c in comp.items()}
    return [r for r in rows if comp[r.doc_id] == r.doc_id]


def plain_shares(budget, children):
    """Whole tokens of each child {name: (weight, capacity)}: the most limited are filled, the others share what is left."""
    order, out = sorted(children, key=lambda n: (children[n][1] / children[n][0], n)), {}
    for k, n in enumerate(order):
        w, cap = children[n]
        if cap * sum(children[x][0] for x in order[k:]) > budget * w:
            total, done = sum(children[x][0] for x in order[k:]), 0
            for x in order[k:]:
                before, done = done, done + children[x][0]
                out[x] = min(children[x][1], budget * done // total - budget * before // total)
            break
        out[n], budget = cap, budget - cap
    return out


def plain_mix(rows, mix):
    size = {r.doc_id: len(words_in(r.text)) for r in rows}
    leaf_of = lambda r: ("~" if r.source is None else f"d{zlib.crc32(r.source.encode()) % 4}", r.lang or "~", r.source or "~")
    leaves = defaultdict(list)
    for r in rows:
        if size[r.doc_id]:
            leaves[leaf_of(r)].append(r)
    caps = {k: mix.epochs * sum(size[r.doc_id] for r in v) for k, v in leaves.items()}
    quotas = {(): sum(size.values()) * mix.budget_percent // 100}
    for depth, level in enumerate(mix.levels):
        children = defaultdict(dict)
        for k, c in caps.items():
            name = k[: depth + 1]
            children[k[:depth]][name] = (mix.weights[level].get(k[depth], mix.default_weight), children[k[:depth]].get(name, (0, 0))[1] + c)
        quotas = {n: q for parent, b in quotas.items() for n, q in plain_shares(b, children[parent]).items()}
    taken = set()
    for k, docs in leaves.items():
        for epoch in range(mix.epochs):
            room = quotas[k] - epoch * sum(size[r.doc_id] for r in docs)
            for r in sorted(docs, key=lambda r: (hashlib.md5(f"{mix.seed}:{epoch}:{r.doc_id}".encode()).hexdigest(), r.doc_id)):
                if room <= 0:
                    break
                taken.add(r.doc_id)
                room -= size[r.doc_id]
    return [r for r in rows if r.doc_id in taken]


def check_packed(rows, packed):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in packed:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {r.doc_id for r in rows}
    for r in rows:
        ids, at = tok.encode(r.text or "", add_special_tokens=False).ids + [1], 0
        for n, p in enumerate(sorted(by_doc[r.doc_id], key=lambda p: p.piece)):
            part = ids[at : at + 4096]
            assert (p.piece, p.start, p.length, p.ids_crc32) == (n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += len(part)
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_run_equals_plain_stages(spark):
    """All of run() on sf0.001, stage by stage, against versions in plain Python."""
    import corpus_pipeline as P

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows, scratch = docs.collect(), Scratch(spark)
    model = quality_classifier.train(docs.select("doc_id", "text"), labels)
    plain = [lambda r: plain_good(r, model), plain_rules, plain_dedup, lambda r: plain_mix(r, P.MIX)]
    for (name, stage), other in zip(P.STAGES, plain):
        out, want = scratch.write(stage(spark, docs, SF)), other(rows)
        assert out.columns == docs.columns
        assert sorted(out.collect()) == sorted(want), name
        assert 0 < len(want) < len(rows), name
        docs, rows = out, want
    check_packed(rows, P.run(spark, SF).collect())


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = P.run(spark, SF)
    assert len(list(tmp_path.glob("hushjoin-*/*"))) == 1 and out.count() > 0


def test_the_shared_folder():
    class Session:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": folder} if folder else {}, self
            self.master = master

    assert common.shared_dir(Session("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    assert common.shared_dir(Session("local[2]", None)).startswith("file:///")
    with pytest.raises(ValueError):
        common.shared_dir(Session("spark://x", None))


def test_stages_with_empty_and_null_rows(spark):
    """Null ids, texts, languages and sources, repeated rows, a further column."""
    import corpus_pipeline as P

    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    text = " ".join(f"w{i}" for i in range(70))
    other = " ".join(f"v{i}" for i in range(70))
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text + " x", "de", None, 1), (None, text, None, "s", 1), (None, other, None, None, 1)]
    nulls = spark.createDataFrame(rows, empty.schema).withColumn("__row", F.lit("more"))
    got = {}
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
        got[name] = stage(spark, nulls, SF)
    full = [r for r in nulls.collect() if r.text]
    assert all(got[n].columns == nulls.columns for n, _ in P.STAGES[:4])
    judged = quality_classifier.quality_scores(nulls, table(spark, SF, "labels")).filter("predicted = 1")
    assert Counter(r.doc_id for r in got["quality_classifier"].collect()) == Counter(r.doc_id for r in judged.collect())
    assert Counter(got["quality_rules"].collect()) == Counter(full)  # null and empty texts have too few words
    # 4 is a near copy of 3, whose rows stay both; rows without an id stay
    assert Counter(r.doc_id for r in got["near_dups"].collect()) == Counter([None, None, None, 1, 2, 3, 3])
    mixed = Counter(got["mixing"].collect())
    assert mixed <= Counter(full) and sum(mixed.values()) >= 4 and None in {r.doc_id for r in mixed}
    packed = got["packing"].collect()
    assert Counter(r.doc_id for r in packed) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_topk_search", "op7_mixing", "op8_url_filter"])
def test_queries_match_sql(spark, name):
    from hushjoin.llm import queries as Q

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert norm(Q.queries()[name](spark, SF).toPandas()) == norm(con.execute(Q.oracle_sql()[name]).df())
