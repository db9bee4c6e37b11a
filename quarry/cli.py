"""Command line: index, search, extract, sql, query, list, delete, convert, gpu-info."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from quarry.engine import Engine
from quarry.functions import models
from quarry.operators import report
from quarry.plans import sql as dialect
from quarry.plans.tree import boolean_query
from quarry.sources import convert


def share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must be from 0 to 1")
    return value


def count(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be over 0")
    return value


def read_spec(text: str) -> dict:
    """A query tree from JSON text, or from a file."""
    return json.loads(text if text.lstrip().startswith("{") else Path(text).read_text())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry")
    top.add_argument("--root", default="corpora", help="where the tables are")
    top.add_argument("--embed-url", help="server of an embedding model, in place of hashed words")
    top.add_argument("--embed-model", default="all-minilm")
    top.add_argument("--embed-dim", type=count, default=384)
    top.add_argument("--embed-about-url", help="where that server tells of its models, to be asked for the context's length")
    top.add_argument("--answer-url", help="server of a model that answers, in place of first lines")
    top.add_argument("--answer-model", default="default")
    top.add_argument("--answer-form", choices=sorted(models.FORMS), default="completion")
    top.add_argument("--temperature", type=share, default=0.0)
    top.add_argument("--header", action="append", default=[], metavar="NAME:VALUE", help="sent with every request to a model")
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    p = add("index")
    p.add_argument("paths", nargs="+")
    p.add_argument("--corpus", help="one corpus for all files, in place of one for each stem")
    p = add("query")
    p.add_argument("spec", help="a query tree as JSON, or the path of a file with one")
    p.add_argument("--output")
    for name in ("search", "extract"):
        p = add(name)
        p.add_argument("query")
        p.add_argument("--corpus", action="append")
        p.add_argument("--exclude", action="append")
        p.add_argument("--union", action="store_true")
        p.add_argument("--semantic", action="store_true")
        p.add_argument("--threshold", type=share, default=0.7)
        p.add_argument("--min-score", type=share, default=0.3)
        p.add_argument("--max-chunks", type=count)
        p.add_argument("--top-k", type=count, default=5)
        p.add_argument("--output", default="extracted")
    p = add("sql")
    p.add_argument("query")
    p.add_argument("--output")
    p.add_argument("--tree", action="store_true", help="print the query tree as JSON and stop")
    add("gpu-info")
    add("list")
    add("delete").add_argument("corpus")
    p = add("convert")
    p.add_argument("paths", nargs="+")
    p.add_argument("--output", default="converted_md")
    p.add_argument("--format", default="markdown", choices=["markdown", "text"])
    p.add_argument("--dpi", type=count, default=300, help="for converters that read scans")
    p.add_argument("--lang", help="languages for these")
    p.add_argument("--force-ocr", action="store_true")
    return top


def engine_of(spark: SparkSession, a: argparse.Namespace) -> Engine:
    """The engine with the models that the options name."""
    headers = dict((part.strip() for part in h.split(":", 1)) for h in a.header)
    embedder = models.HttpEmbedder(a.embed_url, a.embed_model, a.embed_dim, headers=headers, about_url=a.embed_about_url) if a.embed_url else None
    if not a.answer_url:
        return Engine(spark, a.root, embedder)
    return Engine(spark, a.root, embedder, models.HttpGenerator(a.answer_url, a.answer_model, models.FORMS[a.answer_form], a.temperature, headers))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "sql" and a.tree:
        print(json.dumps(dialect.parse(a.query), indent=2))
        return 0
    spark = SparkSession.builder.getOrCreate()
    engine = engine_of(spark, a)
    if a.command == "index":
        engine.index({a.corpus: a.paths} if a.corpus else a.paths).show(truncate=False)
    elif a.command in ("search", "extract") and (a.union or a.exclude):
        spec = boolean_query(a.query, a.exclude, a.union, a.corpus, a.min_score, a.max_chunks, a.semantic, a.threshold)
        rows = engine.query(spec)
        if a.command == "extract":
            report.write_report(report.chunk_report(rows), a.output)
        else:
            print(engine.answer(a.query, rows))
    elif a.command == "search":
        print(json.dumps(engine.search(a.query, a.corpus, a.top_k, a.min_score), indent=2))
    elif a.command == "extract":
        engine.extract(a.query, a.output, corpora=a.corpus, min_score=a.min_score, max_chunks=a.max_chunks).show()
    elif a.command in ("sql", "query"):
        rows = engine.sql(a.query) if a.command == "sql" else engine.query(read_spec(a.spec))
        report.write_report(report.result_lines(rows), a.output) if a.output else rows.show(truncate=80)
    elif a.command == "gpu-info":
        amount = spark.conf.get("spark.executor.resource.gpu.amount", None)
        print(json.dumps({"executor_gpus": int(amount or 0), "used": False}))
    elif a.command == "list":
        engine.catalog.corpora().orderBy("corpus").show(truncate=False)
    elif a.command == "delete":
        engine.catalog.delete(a.corpus)
    elif a.command == "convert":
        done = convert.convert(convert.read_files(spark, a.paths), dpi=a.dpi, lang=a.lang, force_ocr=a.force_ocr).persist()
        body = "markdown" if a.format == "markdown" else "text"
        done.where("error is null").select("file_name", body).write.mode("overwrite").partitionBy("file_name").text(a.output)
        done.where("error is not null").select("path", "error").show(truncate=False)
        convert.conversion_stats(done).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
