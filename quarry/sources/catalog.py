"""Corpora as one Parquet table, with a catalog of the files that are indexed.

    <root>/chunks/corpus=<name>/file=<id>/...   <root>/corpora/corpus=<name>/file=<id>/...

A corpus has one file or many. Both tables are written by dynamic partition
overwrite, so one job indexes any number of files and replaces just these, each
on its own; every file has a row in both, with chunk -1 in the first, so one that
became blank loses its old chunks. A file is skipped when its path, time and size,
the embedding model and the chunk size are those it was indexed with.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.embedding import Embedder, HashedWords, embed
from quarry.functions.text import stem
from quarry.operators.chunk import chunk_documents, chunk_size
from quarry.schema import CHUNKS, CORPORA, names
from quarry.sources.splits import chunk_files

SETTINGS = ["embedding_model", "embedding_dim", "index_type", "normalized"]
SEEN = ["corpus", "file_path", "file_modified", "file_size", "embedding_model", "chunk_size"]
CONTEXT_LENGTH = 256
REMOTE = ("http://", "https://", "git@", "ssh://", "git://")
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
Inputs = Sequence[str] | Mapping[str, str | Sequence[str]]


# ---- input


def _status(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def input_error(spark: SparkSession, path: str) -> str | None:
    """Why a path cannot be indexed: an address, nothing there, a directory or a repository; null for a file and for a pattern."""
    if path.startswith(REMOTE):
        return f"not a file but an address: {path}"
    if path.rstrip("/").rsplit("/", 1)[-1].endswith(".git"):
        return f"not a file but a repository: {path}"
    if re.search(r"[*?\[{]", path):
        return None
    files, found = _status(spark, path)
    if not files.exists(found):
        return f"file not found: {path}"
    if files.getFileStatus(found).isDirectory():
        kind = "repository" if files.exists(spark._jvm.org.apache.hadoop.fs.Path(found, ".git")) else "directory"
        return f"not a file but a {kind}: {path}"
    return None


def pairs_of(inputs: Inputs) -> list[tuple[str | None, str]]:
    """(corpus or null, path) of what a caller names: paths, or {corpus: path or paths}."""
    if not isinstance(inputs, Mapping):
        return [(None, p) for p in inputs]
    return [(corpus, p) for corpus, paths in inputs.items() for p in ([paths] if isinstance(paths, str) else paths)]


def describe_files(files: DataFrame, corpus: Column | None = None) -> DataFrame:
    """Rows of Spark's binary files as corpus (else the file's stem), source (its name), text, error, and the manifest columns."""
    said = F.col("content").cast("string")
    good = F.is_valid_utf8(said)
    return files.select(
        F.coalesce(corpus, stem(F.col("path"))).alias("corpus") if corpus is not None else stem(F.col("path")).alias("corpus"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("source"), F.when(good, said).alias("text"), F.when(~good, F.lit("not UTF-8 text")).alias("error"),
        F.col("path").alias("file_path"), F.col("modificationTime").alias("file_modified"), F.col("length").alias("file_size"),
    )


def read_texts(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """The named files, empty ones too, by one job for all paths and patterns; refuses paths that are no files."""
    pairs = pairs_of(inputs)
    errors = [e for e in (input_error(spark, p) for _, p in pairs) if e]
    if errors:
        raise ValueError("; ".join(errors))
    wanted, empty = [], []
    for corpus, path in pairs:
        store, pattern = _status(spark, path)
        for f in store.globStatus(pattern) or []:
            name = f.getPath().toString()
            if isinstance(inputs, Mapping):
                wanted.append((name, corpus))
            if f.isFile() and not f.getLen():  # these Spark's readers pass over
                empty.append((name, datetime.fromtimestamp(f.getModificationTime() / 1000), 0, b""))
    files = spark.read.format("binaryFile").load([p for _, p in pairs])
    if empty:
        files = files.unionByName(spark.createDataFrame(empty, BINARY_FILES))
    if not isinstance(inputs, Mapping):
        return describe_files(files)
    known = spark.createDataFrame(wanted, "path string, _corpus string")  # what the caller named
    return describe_files(files.dropDuplicates(["path"]).join(F.broadcast(known), "path"), F.col("_corpus"))


# ---- the catalog's rows


def stale_rows(manifest: DataFrame, stored: DataFrame, seen: Sequence[str] = SEEN) -> DataFrame:
    """Rows of a manifest that are not stored as they stand."""
    return manifest.join(stored.select(*seen), list(seen), "left_anti")


def totals(corpora: DataFrame) -> DataFrame:
    """One row for each corpus: its files, size, chunks and settings."""
    counts = [F.count("*").alias("files"), F.sum("file_size").alias("file_size"), F.sum("chunk_count").alias("chunk_count")]
    return corpora.groupBy("corpus").agg(*counts, *[F.first(c).alias(c) for c in SETTINGS])


def listing_of(corpora: DataFrame) -> DataFrame:
    return corpora.select("corpus").distinct().orderBy("corpus")


def named(files: DataFrame, stored: DataFrame) -> DataFrame:
    """files (corpus, source, file_path) with sources that are one file's each: a name that another file of the corpus has gives way to the path."""
    first = files.groupBy("corpus", "source").agg(F.min("file_path").alias("_first"))
    taken = stored.select("corpus", "source", F.col("file_path").alias("_taken"))
    owners = first.join(taken, ["corpus", "source"], "left").select("corpus", "source", F.coalesce("_taken", "_first").alias("_owner"))
    source = F.when(F.col("file_path") == F.col("_owner"), F.col("source")).otherwise(F.col("file_path"))
    return files.join(owners, ["corpus", "source"]).withColumn("source", source).drop("_owner")


class Catalog:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, context_length: int | None = None):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder or HashedWords()
        # what the caller says, else the model
        self.context_length = context_length or getattr(self.embedder, "context_length", None) or CONTEXT_LENGTH

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS).where("chunk_index >= 0")

    def corpora(self) -> DataFrame:
        """A row for each file."""
        return self._read("corpora", CORPORA)

    def stale(self, manifest: DataFrame) -> DataFrame:
        return stale_rows(manifest, self.corpora())

    def index(self, texts: DataFrame, size: int | None = None) -> DataFrame:
        """Indexes the files that are new or changed (see `read_texts`) and returns their catalog rows; one that is no text is a row with its error."""
        size = size or chunk_size(self.context_length)

        def chunks_of(todo: DataFrame) -> DataFrame:
            docs = texts.select("corpus", "file_path", "text", "error").join(todo.select("corpus", "file_path", "file", "source"), ["corpus", "file_path"])
            return chunk_documents(docs, size, ("corpus", "file", "source"), mark="error")

        return self._index(texts.drop("text", "error"), size, chunks_of)

    def index_large(self, paths: Sequence[str], size: int | None = None) -> DataFrame:
        """As `index`, for UTF-8 text files of any size, each a corpus by its stem: they are read by byte ranges, and no row holds one."""
        size = size or chunk_size(self.context_length)
        errors = [e for e in (input_error(self.spark, p) for p in paths) if e]
        if errors:
            raise ValueError("; ".join(errors))
        files = self.spark.read.format("binaryFile").load(list(paths))  # contents are not asked for
        manifest = files.select(
            stem(F.col("path")).alias("corpus"), F.regexp_extract("path", "([^/]*)$", 1).alias("source"), F.col("path").alias("file_path"),
            F.col("modificationTime").alias("file_modified"), F.col("length").alias("file_size"),
        )

        def chunks_of(todo: DataFrame) -> DataFrame:
            own = todo.select("corpus", "file", "source", "file_path")
            read = [r["file_path"] for r in own.collect()]  # those that are new or changed
            marks = own.select("corpus", "file", "source", F.lit(-1).alias("chunk_index"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit(None).cast("string").alias("chunk"))
            if not read:
                return marks
            made = chunk_files(self.spark, read, size).withColumnRenamed("path", "file_path").join(own, "file_path")
            return made.select(*marks.columns).unionByName(marks)

        return self._index(manifest, size, chunks_of)

    def _index(self, manifest: DataFrame, size: int, chunks_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """chunks_of(files to be done) -> their chunks, and a row of chunk_index -1 for each with its error."""
        run = uuid.uuid4().hex
        settings = {"embedding_model": F.lit(self.embedder.model), "chunk_size": F.lit(size), "file": F.md5("file_path")}
        todo = self.stale(manifest.withColumns(settings))
        staged = f"{self.root}/staged/{run}"  # what is to be done is fixed before the catalog changes
        named(todo, self.corpora()).write.parquet(staged)
        todo = self.spark.read.schema(todo.schema).parquet(staged)
        # contents are read, chunked and embedded once; what is counted and written is this run's alone
        vector = F.when(F.col("chunk_index") >= 0, embed(F.col("chunk"), self.embedder))
        chunks_of(todo).withColumn("embedding", vector).select(*names(CHUNKS)).write.parquet(f"{staged}-chunks")
        made = self.spark.read.schema(CHUNKS).parquet(f"{staged}-chunks")
        self._write(made, "chunks")
        is_chunk = F.col("chunk_index") >= 0
        counts = made.groupBy("corpus", "file").agg(F.count_if(is_chunk).alias("chunk_count"), F.max(F.when(~is_chunk, F.col("chunk"))).alias("error"))
        rows = todo.join(counts, ["corpus", "file"]).withColumns(
            {
                "embedding_dim": F.lit(self.embedder.dim), "index_type": F.lit("inner product"), "normalized": F.lit(True),
                "context_length": F.lit(self.context_length), "run": F.lit(run),
            }
        )
        self._write(rows.select(*names(CORPORA)), "corpora")
        self._remove(staged)
        self._remove(f"{staged}-chunks")
        return self.corpora().where(F.col("run") == run)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus", "file").parquet(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        store, found = _status(self.spark, path)
        store.delete(found, True)

    def listing(self) -> DataFrame:
        return listing_of(self.corpora())

    def info(self, corpus: str) -> DataFrame:
        found = self.corpora().where(F.col("corpus") == corpus)
        if not found.take(1):
            raise FileNotFoundError(f"no corpus named {corpus}")
        return totals(found)

    def delete(self, corpus: str) -> None:
        """Drops the partitions of a corpus, on whatever file system they are."""
        self.info(corpus)
        folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(corpus)
        for name in ("chunks", "corpora"):
            self._remove(f"{self.root}/{name}/corpus={folder}")
        self.spark.catalog.refreshByPath(self.root)

    def compatible(self, corpora: Sequence[str]) -> dict:
        """The settings that all named corpora share; ValueError where they differ or one is missing."""
        if not corpora:
            return {}
        found = self.corpora().where(F.col("corpus").isin(*corpora))
        if found.select("corpus").distinct().count() < len(set(corpora)):
            raise ValueError("some corpora are not indexed")
        return one_setting(found)


def one_setting(corpora: DataFrame) -> dict:
    kinds = corpora.select(*SETTINGS).distinct().take(2)
    if len(kinds) > 1:
        raise ValueError("corpora were indexed with different settings")
    return kinds[0].asDict() if kinds else {}


def setting_conflicts(corpora: DataFrame) -> DataFrame:
    """One row: corpora, and how many different settings they have; more than one cannot be searched together."""
    return corpora.agg(F.countDistinct("corpus").alias("corpora"), F.countDistinct(F.struct(*SETTINGS)).alias("settings"))
