"""Chunks as a data source of Spark: `df.write.format("quarry").save(root)`, `spark.read.format("quarry").load(root)`.

    <root>/data/<run>/<file>.parquet   <root>/manifests/<run>.parquet   <root>/_snapshot

Each write is a run. Its tasks write files of one corpus each, and say which; when
all are done the driver writes the run's manifest, and by one rename a new
`_snapshot`, which names the manifests that count. A reader goes by these alone:
what a killed or failed write left is not seen, an overwrite is seen whole or not
at all, and no folder is listed. One writer at a time; old runs' files stay until
`vacuum`.

Conditions on `corpus` pick files before any is opened. With the option `vector`
(a JSON list) rows have a `score`, their inner product with it, and conditions on
the score are decided in the reader, so rows that fail never reach Spark. File
systems are those that Arrow knows by their address: local and shared folders, hdfs,
s3, gs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from quarry.functions.vector import TILE

SCHEMA = "corpus string, source string, chunk_index long, line_start long, line_end long, chunk string, embedding array<double>"
FIELDS = pa.schema(
    [("corpus", pa.string()), ("source", pa.string()), ("chunk_index", pa.int64()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("chunk", pa.string()), ("embedding", pa.list_(pa.float64()))]
)
MANIFEST = pa.schema([("path", pa.string()), ("corpus", pa.string()), ("rows", pa.int64())])
FILE_BYTES = 128 << 20
OPEN_FILES = 32


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root.rstrip("/")) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root.rstrip("/"))


def snapshot(root: str) -> list[str]:
    """The manifests that count; none before the first write."""
    store, path = store_of(root)
    if store.get_file_info(f"{path}/_snapshot").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{path}/_snapshot") as file:
        return json.loads(file.read())["manifests"]


def live_files(root: str, corpora: Sequence[str] | None = None) -> list[dict]:
    """path, corpus, rows of the files of a snapshot; of these corpora where some are named."""
    store, path = store_of(root)
    wanted = None if corpora is None else pc.field("corpus").isin(list(corpora))
    return [row for run in snapshot(root) for row in pq.read_table(f"{path}/manifests/{run}.parquet", filesystem=store, filters=wanted).to_pylist()]


# ---- reading


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, root: str, schema: StructType, vector: list[float] | None):
        self.root, self.names, self.vector = root, schema.names, vector
        self.corpora: list[str] | None = None
        self.least, self.above = -np.inf, -np.inf

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = f.attribute[0] if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | IsNotNull) and len(f.attribute) == 1 else None
            if at == "corpus" and isinstance(f, EqualTo | In):
                named = list(f.value) if isinstance(f, In) else [f.value]
                self.corpora = [c for c in named if self.corpora is None or c in self.corpora]
            elif at == "score" and isinstance(f, GreaterThanOrEqual) and self.vector is not None:
                self.least = max(self.least, f.value)
            elif at == "score" and isinstance(f, GreaterThan) and self.vector is not None:
                self.above = max(self.above, f.value)
            elif not (at == "score" and isinstance(f, IsNotNull)):  # a row without a vector has no score
                yield f

    def partitions(self) -> list[InputPartition]:
        return [File(f["path"]) for f in live_files(self.root, self.corpora)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of no files
            return
        store, path = store_of(self.root)
        with store.open_input_file(f"{path}/data/{partition.path}") as file:
            for batch in pq.ParquetFile(file).iter_batches(4096):
                yield from self.scored(batch)

    def scored(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.vector is None:
            yield batch.select(self.names)
            return
        query, vectors = np.array(self.vector, np.float64), batch.column("embedding")
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(query)), False)
        batch = batch.filter(fits)
        vectors = batch.column("embedding")
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, len(query)))
        score = np.concatenate([np.zeros(0), *(x[i : i + TILE] @ query for i in range(0, len(x), TILE))])
        kept = pa.array((score >= self.least) & (score > self.above))
        whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"]).filter(kept)
        if whole.num_rows:
            yield whole.select(self.names)


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str | None, int]]


class Writer(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.run = root, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file for each corpus of the task, and a further one where it grows past `FILE_BYTES`; each attempt has names of its own."""
        store, path = store_of(self.root)
        store.create_dir(f"{path}/data/{self.run}", recursive=True)
        held: dict = {}
        done = []

        def close(corpus):
            name, writer, rows, _ = held.pop(corpus)
            writer.close()
            done.append((name, corpus, rows))

        for batch in iterator:
            batch = pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in FIELDS], schema=FIELDS)
            for corpus in pc.unique(batch.column("corpus")).to_pylist():
                own = batch.filter(pc.is_null(batch.column("corpus")) if corpus is None else pc.fill_null(pc.equal(batch.column("corpus"), corpus), False))
                if corpus not in held:
                    if len(held) >= OPEN_FILES:
                        close(next(iter(held)))
                    name = f"{self.run}/{uuid.uuid4().hex}.parquet"
                    held[corpus] = [name, pq.ParquetWriter(f"{path}/data/{name}", FIELDS, filesystem=store, compression="zstd"), 0, 0]
                at = held[corpus]
                at[1].write_batch(own)
                at[2] += own.num_rows
                at[3] += own.nbytes
                if at[3] > FILE_BYTES:
                    close(corpus)
        for corpus in list(held):
            close(corpus)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = store_of(self.root)
        store.create_dir(f"{path}/manifests", recursive=True)
        files = [f for m in messages if m for f in m.files]
        table = pa.table([pa.array([f[i] for f in files], MANIFEST.types[i]) for i in range(3)], schema=MANIFEST)
        pq.write_table(table, f"{path}/manifests/{self.run}.parquet", filesystem=store)
        point(self.root, [*([] if self.overwrite else snapshot(self.root)), self.run])

    def abort(self, messages: list[Written | None]) -> None:
        store, path = store_of(self.root)
        if store.get_file_info(f"{path}/data/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/data/{self.run}")


def point(root: str, manifests: list[str]) -> None:
    """Makes these manifests the table, by one rename."""
    store, path = store_of(root)
    new = f"{path}/_snapshot-{uuid.uuid4().hex}"
    with store.open_output_stream(new) as file:
        file.write(json.dumps({"manifests": manifests}).encode())
    store.move(new, f"{path}/_snapshot")


def vacuum(root: str) -> list[str]:
    """Removes the runs that no snapshot names, and returns them. Not while a write or an older read is under way."""
    store, path = store_of(root)
    runs = [f for f in store.get_file_info(fs.FileSelector(f"{path}/data", allow_not_found=True)) if f.base_name not in snapshot(root)]
    for run in runs:
        store.delete_dir(run.path)
    return sorted(r.base_name for r in runs)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry"

    def schema(self) -> str:
        return SCHEMA + (", score double" if "vector" in self.options else "")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, json.loads(self.options["vector"]) if "vector" in self.options else None)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand it conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
