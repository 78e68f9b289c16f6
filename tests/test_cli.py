"""Commands end to end, and generated tables."""

import json
import zipfile

from hushjoin import cli
from hushjoin.functions import crypto
from hushjoin.operators import tokens
from hushjoin.operators.overlap import Overlap
from hushjoin.operators.tokens import Pipeline
from hushjoin.sources import exchange, files, generate


def test_commands(spark, tmp_path, capsys):
    left, right = generate.linked(spark)
    for name, df in (("l", left), ("r", right)):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for who in ("a", "b"):
        assert cli.main(["generate-keys", "--folder", str(tmp_path / "keys"), "--name", who]) == 0
    doc = str(tmp_path / "x.exchange.json")
    keys = tmp_path / "keys"
    assert cli.main(["initiate-exchange", "--name", "n", "--sender", str(keys / "a.public.pem"), "--recipient", str(keys / "b.public.pem"), "-o", doc]) == 0
    with_key = ["--exchange", doc, "--private-key", str(keys / "a.private.pem")]
    sealed = []
    for name in ("l", "r"):
        assert cli.main(["tokenize", "-i", str(tmp_path / f"{name}.parquet"), *with_key]) == 0
        made = str(tmp_path / f"{name}_tokenized.parquet")
        meta = json.load(open(files.metadata_path(made)))
        assert meta["TotalRows"] == (100 if name == "l" else 120) and sum(meta["BlankTokensByRule"].values()) < 20
        assert cli.main(["encrypt", "-i", made, *with_key]) == 0
        sealed.append(str(tmp_path / f"{name}_tokenized_encrypted.parquet"))
    capsys.readouterr()
    assert cli.main(["overlap", *sealed, "--rules", "T1,T3,T4,T5", *with_key]) == 0
    assert "40 matching" in capsys.readouterr().out
    assert cli.main(["decrypt", "-i", sealed[0], "--exchange", doc, "--private-key", str(keys / "b.private.pem")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["failed"] == 0
    strict = ["--strict", "-o", str(tmp_path / "s.parquet"), *with_key]
    assert cli.main(["decrypt", "-i", sealed[0], *strict]) == 0 and cli.main(["decrypt", "-i", str(tmp_path / "l_tokenized.parquet"), *strict]) == 1
    assert cli.main(["encrypt", "-i", str(tmp_path / "l_tokenized.parquet"), "-o", str(tmp_path / "e.zip"), *with_key]) == 0
    inside = {n.split("/")[0] for n in zipfile.ZipFile(tmp_path / "e.zip").namelist()}
    assert inside == {"e.parquet", "e.exchange.json", "l_tokenized.metadata.json"}
    back = files.read_tokens(spark, str(tmp_path / "l_tokenized_encrypted_decrypted.parquet"))
    assert back.exceptAll(files.read_tokens(spark, str(tmp_path / "l_tokenized.parquet"))).count() == 0
    assert cli.main(["package", "-i", str(tmp_path / "l.parquet"), "-o", str(tmp_path / "p.zip"), *with_key]) == 0
    assert {n.split("/")[0] for n in zipfile.ZipFile(tmp_path / "p.zip").namelist()} == {"p.parquet", "p.metadata.json", "p.exchange.json"}
    assert cli.main(["tokenize", "-i", str(tmp_path / "l.parquet"), "-o", str(tmp_path / "d.csv"), "--mode", "demo"]) == 0
    assert cli.main(["tokenize", "-i", "none.txt", "--mode", "demo"]) == 1


def test_generated_tables(spark):
    left, right = generate.linked(spark)
    pipe = Pipeline.keyed("s")
    over = Overlap(tokens.tokenize(left, pipe), tokens.tokenize(right, pipe), include_blank=False)
    assert over.matches(["T1", "T2", "T3", "T4", "T5"]).count() >= 35
    again = generate.persons(spark, 10, repeats=2)
    assert again.count() == 20 and again.drop("RecordId").distinct().count() == 10
    assert crypto.BLANK not in {r.Token for r in tokens.tokenize(again, pipe).filter("RuleId = 'T3'").collect()}
    assert exchange.default_path().name.endswith(".exchange.json")
