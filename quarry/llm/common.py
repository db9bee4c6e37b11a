"""Small helpers shared by the corpus operators.

Texts travel to Python as UTF-8 bytes (`cast("binary")`), because every word
rule used here can be decided on bytes: the separators are ASCII, and in UTF-8
an ASCII byte is never a part of another character.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A-Z to a-z on UTF-8 bytes.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z to a-z, and every other ASCII byte that is not a letter or digit to a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`; bytes.split() parts at just these six bytes."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads the bits of a polynomial hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Rabin-Karp hashes, modulo 2**64, of all windows of k consecutive word hashes.

    With prefix sums S of h[i] * B**i the window at i is (S[i+k] - S[i]) * B**-i,
    so each window costs one subtraction and one product for any k.
    """

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, step in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, step, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=sums[1:])
        return sums

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(n)
        return mix((sums[k:] - sums[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out[:n]


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def integer_ids(docs: DataFrame) -> DataFrame:
    """`docs`, if its doc_id is of an integer type; ids of other types have no order that the results could follow."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all of the session is one process, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders written by `cut` outside of any `owned_cuts` and not dropped yet, in order.
CUTS: list[str] = []
_owners = threading.local()


@contextmanager
def owned_cuts(spark: SparkSession) -> Iterator[list[str]]:
    """A list of its own for the folders that this thread cuts in here; where it fails they are removed."""
    stack = _owners.__dict__.setdefault("stack", [])
    made: list[str] = []
    stack.append(made)
    try:
        yield made
    except BaseException:
        remove(spark, made)
        raise
    finally:
        stack.pop()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder as Parquet and reads them back: a lost executor re-reads them, and the lineage ends here. `drop_cuts` removes them when results are done."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    (_owners.__dict__.get("stack") or [CUTS])[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Removes the folders `CUTS[first:last]`. Results that are not yet written or collected may still read theirs."""
    gone = CUTS[first:last]
    del CUTS[first:last]
    remove(spark, gone)


def remove(spark: SparkSession, gone: list[str]) -> None:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def no_rows(df: DataFrame) -> bool:
    return not df.take(1)


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ints_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst): the smallest node reachable.

    Each round points every node at its smallest neighbour, follows that pointer
    once more, and rewrites the edges between the nodes pointed at; edges inside
    one node go. At least half of the nodes with edges disappear in a round, so
    the rounds grow as the logarithm of the nodes. All of it are joins and
    aggregates with map-side combine; nothing but a row count reaches the driver.
    """
    edges = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    maps: list[DataFrame] = []
    while not no_rows(edges):
        if len(maps) >= rounds:
            raise RuntimeError("connected components did not settle")
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("up"))
        above = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = cut(near.join(above, "up").select("node", F.least("up", "top").alias("up")))
        maps.append(step)
        at = lambda side: step.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))
        moved = edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_up").alias("src"), F.col("dst_up").alias("dst"))
        edges = cut(moved.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    if not maps:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        then = step.select(F.col("node").alias("component"), F.col("up").alias("next"))
        return found.join(then, "component", "left").select("node", F.coalesce("next", "component").alias("component"))

    return reduce(follow, maps[1:], maps[0].select("node", F.col("up").alias("component")))


def with_columns_from(df: DataFrame, fn, new: str, needs: dict[str, Column], keep: list[str]) -> DataFrame:
    """`keep` columns of `df` and the columns of DDL `new`, made by Arrow batches.

    fn(batch of the `needs` columns) -> one pa.Array (or list) for each new column.
    A kept column with the name of a new one gives way to it.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    keep = [c for c in keep if c not in added.names]
    tags = {f"_in_{k}": v for k, v in needs.items()}
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in tags.items()])
    schema = StructType([*[source.schema[c] for c in keep], *added.fields])
    width, names, asked = len(keep), schema.names, list(needs)

    def run(batches):
        for batch in batches:
            inputs = pa.RecordBatch.from_arrays(batch.columns[width:], names=asked)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(pa.array, fn(inputs))], names=names)

    return source.mapInArrow(run, schema)


def with_columns_beside(df: DataFrame, fn, new: str, needs: dict[str, Column], keep: list[str]) -> DataFrame:
    """As `with_columns_from`, for kept columns that are large: they stay in the JVM, in pages that count as the task's memory and spill, and only `needs` go to Python and only new columns come back.

    fn returns an Arrow array for each new column. Its values are made once for each
    row, whatever reads or filters by them; so they are marked as not deterministic.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    keep = [c for c in keep if c not in added.names]
    kinds, names, asked = [to_arrow_type(f.dataType) for f in added.fields], added.names, list(needs)

    def run(*columns: pa.Array) -> pa.Array:
        made = fn(pa.RecordBatch.from_arrays(list(columns), names=asked))
        return pa.StructArray.from_arrays([pa.array(c).cast(k) for c, k in zip(made, kinds, strict=True)], names=names)

    made = F.arrow_udf(run, added).asNondeterministic()(*needs.values())
    kept = [F.col(f"`{c}`") for c in keep]
    return df.select(*kept, made.alias("_quarry_made")).select(*kept, "_quarry_made.*")


def as_bytes(column: str = "text") -> Column:
    return F.col(column).cast("string").cast("binary")
