"""From raw documents to packed sequences: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of their input, whatever further ones it has. Stages may be
run one by one over written Parquet, as `run` does.

Defined cases, for every stage: an empty table gives an empty table; a repeated
row is a row of its own until near duplicates go; a null id is an id like no
other. Null and empty texts are judged by the quality model as an empty text,
are no one's duplicates, lose no words, hold no benchmark words, and pack as the
end mark alone; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, near_dedup, packing, quality, substring_dedup
from quarry.llm.common import CUTS, cut, id_bucket, owned_cuts, remove


def apart(docs: DataFrame, *but: str) -> DataFrame:
    """doc_id and text, and all columns, `but` some, packed away, so that none of them meets a new column of its name."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("_row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go; where no label lets one be learned, all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, id_bucket("doc_id", 4) != 2)
    if model is None:
        return docs
    return quality.score_quality(apart(docs), model, keep=["_row"]).where("predicted = 1").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays, that of the smallest id, of equal ids by hash of the text."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that an earlier document has go; what is left keeps its row, with n_chars, where there is one, counted anew."""
    left = substring_dedup.remove_repeats(apart(docs, "text"), keep=["_row"])
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten or more words of a benchmark item in a row go; an item of fewer words has no such row."""
    words = F.regexp_count("text", F.lit(r"[^\x00-/:-@\[-`{-\x7f]+"))  # as alnum_words parts them
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(words >= 10)
    return decontamination.find_contamination(apart(docs), benchmark, keep=["_row"]).where("n_hit = 0").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, each with its sequence and place."""
    return packing.pack_documents(docs, packing.public_tokens())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and minhash components are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`. What a stage wrote for itself goes as soon as its result is written, and all of a run that fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with owned_cuts(spark) as kept:
        for i, (_, stage) in enumerate(STAGES):
            with owned_cuts(spark) as made:
                docs = stage(spark, docs, sf_dir)
                if i + 1 < len(STAGES):
                    docs = cut(docs)
                    remove(spark, kept + made[:-1])
                    del kept[:], made[:-1]
            kept += made
    CUTS.extend(kept)  # the result reads them
    return docs
