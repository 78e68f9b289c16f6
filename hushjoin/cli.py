"""Command line: python -m hushjoin.cli COMMAND ... Data goes through Spark; only keys and reports stay on the driver."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import PySparkException

from hushjoin import extensions
from hushjoin.operators import metadata, tokens
from hushjoin.operators.attributes import FieldRegistry
from hushjoin.operators.overlap import OverlapAnalyzer
from hushjoin.operators.rules import DEFAULT
from hushjoin.sources import config, exchange, files
from hushjoin.sources.persons import read_persons


def session():
    from pyspark.sql import SparkSession

    settings = {"spark.sql.session.timeZone": "UTC", "spark.python.sql.dataFrameDebugging.enabled": "false"}  # plans are built faster without call sites
    return SparkSession.builder.appName("hushjoin").config(map=settings).getOrCreate()


def _exchange(args) -> exchange.Exchange:
    return exchange.resolve(path=args.exchange, private_key_path=args.private_key, private_key_env=args.private_key_env)


def _source(args, spark):
    settings = config.load(args.config) if args.config else None
    registry, rules = (settings.registry, settings.rules) if settings else (FieldRegistry.defaults(), DEFAULT)
    persons = read_persons(spark, args.input, registry, files.detect_type(args.input), settings.columns if settings else None)
    if args.hash_record_ids:
        persons = tokens.record_id_hashes(persons)
    return persons, rules, registry


def _run(args, spark, pipeline, out: str, kind: str | None = None, **secrets) -> str:
    """Write the tokens and, from the counts of the same pass, the report."""
    persons, rules, registry = _source(args, spark)
    made, seen = tokens.tokenize_counted(persons, pipeline, rules, registry)
    files.write_tokens(made, out, kind)
    report = files.metadata_path(out)
    files.write_json(spark, report, metadata.document(seen.get, rules, kind or files.detect_type(out), **secrets))
    return report


def tokenize(args, spark) -> None:
    out = args.output or files.auto_output_path(args.input, "tokenize")
    if args.mode == "default":
        secret = _exchange(args).hashing_secret
        _run(args, spark, tokens.Pipeline.keyed(secret), out, hashing_secret=secret)
    else:
        _run(args, spark, tokens.Pipeline.hash_only() if args.mode == "hash-only" else tokens.Pipeline.plain(), out)


def _sealed_document(spark, stem: str, found: exchange.Exchange) -> str:
    path = f"{stem}.exchange.json"
    files.write_json(spark, path, dict(found.document))
    return path


def package(args, spark) -> None:
    out = args.output or files.auto_output_path(args.input, "package")
    found, stem = _exchange(args), os.path.splitext(out)[0]
    key = exchange.transport_key(found)
    pipeline = tokens.Pipeline.sealed(found.hashing_secret, key, args.ring)
    report = _run(args, spark, pipeline, f"{stem}.parquet", "parquet", hashing_secret=found.hashing_secret, encryption_key=key)
    files.bundle(spark, out, f"{stem}.parquet", report, _sealed_document(spark, stem, found))


def encrypt(args, spark) -> None:
    """A token file, or a zip archive with the tokens, the exchange document and, where the input has one, its report."""
    table, found = files.read_tokens(spark, args.input), _exchange(args)
    out, sealed = args.output or files.auto_output_path(args.input, "encrypt"), tokens.encrypt_tokens(table, exchange.transport_key(found), args.ring)
    if files.detect_type(out, output=True) != "zip":
        files.write_tokens(sealed, out)
        return
    stem, kind = os.path.splitext(out)[0], files.detect_type(args.input)
    files.write_tokens(sealed, f"{stem}.{kind}", kind)
    report = files.metadata_path(args.input)
    files.bundle(spark, out, f"{stem}.{kind}", _sealed_document(spark, stem, found), *([report] if files.exists(spark, report) else []))
    files.delete(spark, f"{stem}.{kind}")


def decrypt(args, spark) -> None:
    table, key = files.read_tokens(spark, args.input), exchange.transport_key(_exchange(args))
    out = args.output or files.auto_output_path(args.input, "decrypt")
    if args.strict:
        files.write_tokens(tokens.decrypt_tokens(table, key, strict=True), out)
        return
    opened, seen = tokens.decrypt_counted(table, key)
    files.write_tokens(opened, out)
    print(json.dumps(seen.get))


def overlap(args, spark) -> None:
    left, right = (files.read_tokens(spark, p) for p in (args.left, args.right))
    analyzer = OverlapAnalyzer(exchange.transport_key(_exchange(args)))
    for result in analyzer.compare(left, right, [s.split(",") for s in args.rules]):
        print(analyzer.summary_text(result))


def generate_keys(args, spark) -> None:
    private, public = exchange.save_key_pair(args.folder, args.name, *exchange.generate_key_pair(args.curve))
    print(private, public, sep="\n")


def initiate_exchange(args, spark) -> None:
    read = lambda p: open(p, "rb").read()
    secret = sys.stdin.buffer.read().strip() if args.secret_stdin else (os.environ[args.secret_env].encode() if args.secret_env else None)
    document = exchange.build(args.name, read(args.sender), read(args.recipient), secret)
    files.write_json(spark, str(args.output or exchange.default_path()), document)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hushjoin", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *flags: str):
        c = sub.add_parser(f.__name__.replace("_", "-"))
        c.set_defaults(run=f)
        if "io" in flags:
            c.add_argument("-i", "--input", required=True)
            c.add_argument("-o", "--output")
        if "persons" in flags:
            c.add_argument("-c", "--config")
            c.add_argument("--hash-record-ids", action="store_true")
        if "keys" in flags:
            c.add_argument("--exchange")
            c.add_argument("--private-key")
            c.add_argument("--private-key-env")
        if "ring" in flags:
            c.add_argument("--ring")
        return c

    command(tokenize, "io", "persons", "keys").add_argument("--mode", choices=("default", "hash-only", "demo"), default="default")
    command(package, "io", "persons", "keys", "ring")
    command(encrypt, "io", "keys", "ring")
    command(decrypt, "io", "keys").add_argument("--strict", action="store_true", help="fail where a token cannot be opened")
    c = command(overlap, "keys")
    c.add_argument("left")
    c.add_argument("right")
    c.add_argument("--rules", action="append", required=True, help="rule ids, parted by commas; once for each rule set")
    c = command(generate_keys)
    c.add_argument("--folder", default=exchange.KEY_FOLDER)
    c.add_argument("--name", default="default")
    c.add_argument("--curve", choices=tuple(exchange.CURVES), default="P-256")
    c = command(initiate_exchange)
    for flag in ("--name", "--sender", "--recipient"):
        c.add_argument(flag, required=True)
    c.add_argument("-o", "--output")
    c.add_argument("--secret-stdin", action="store_true")
    c.add_argument("--secret-env")
    extensions.add_commands(sub, set(sub.choices))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args, session())
    except (ValueError, OSError, PySparkException) as e:
        print(f"hushjoin: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
