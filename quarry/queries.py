"""The registered queries of the retrieval operators, each beside its SQL for an independent engine.

The vector corpus is `embeddings`: corpus by label, a file for each hundred
vectors, ten lines a vector, so that neighbouring ids touch; query i is the vector
with id i. The text corpus is
`documents`: corpus by source, a file for each document.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import bidi, embedding, text, vector
from quarry.operators import cells, chunk, docorder, match, report, retrieve, setops, tablefunction
from quarry.plans import sql as dialect
from quarry.plans import tree
from quarry.sources import catalog, convert, pdf, pdf_write, snapshot, splits
from quarry.sources.shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the vector corpus


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("corpus"),
        F.concat(F.lit("vec_"), F.floor(F.col("vec_id") / 100).cast("string"), F.lit(".txt")).alias("source"),
        F.col("vec_id").alias("chunk_index"),
        (F.col("vec_id") % 100 * 10 + 1).alias("line_start"),
        (F.col("vec_id") % 100 * 10 + 10).alias("line_end"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk"),
        "embedding",
    )


def query_vectors(spark: SparkSession, sf_dir: str, ids: list[int]) -> list[list[float]]:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids)).collect()  # one for each search of a query
    return [{r["vec_id"]: r["embedding"] for r in rows}[i] for i in ids]


def query_vector(spark: SparkSession, sf_dir: str, i: int) -> list[float]:
    return query_vectors(spark, sf_dir, [i])[0]


def scan(spark: SparkSession, sf_dir: str, ids: list[int], min_score: float | None = 0.1, corpora: list[str] | None = None, most: int | None = None) -> DataFrame:
    return retrieve.search_many(vector_corpus(spark, sf_dir), query_vectors(spark, sf_dir, ids), corpora, min_score, most)


def passages(spark: SparkSession, sf_dir: str, n: int) -> tuple[setops.Leaves, list]:
    """Searches 0 to n - 1, met by passage."""
    sets = setops.Leaves(scan(spark, sf_dir, list(range(n))).drop("embedding"), n)
    return sets, [sets.of(i) for i in range(n)]


def leaf(spark: SparkSession, sf_dir: str, i: int, min_score: float | None = 0.1, corpora: list[str] | None = None, most: int | None = None) -> DataFrame:
    return retrieve.search_rows(vector_corpus(spark, sf_dir), query_vector(spark, sf_dir, i), corpora, min_score, most)


def tidy(rows: DataFrame) -> DataFrame:
    return rows.select("corpus", "location", F.round("score", 6).alias("score"), "chunk")


def tree_search(spark: SparkSession, sf_dir: str) -> tree.Search:
    """Searches named "query <i>" are for vector i."""
    return lambda names, o: scan(spark, sf_dir, [int(name.split()[-1]) for name in names], o["min_score"], o["corpuses"], o["max_results"])


VIEW = """v as (
  select 'c' || (label % 3) as corpus, 'vec_' || (vec_id // 100) || '.txt' as source, vec_id as chunk_index, vec_id % 100 * 10 + 1 as line_start, vec_id % 100 * 10 + 10 as line_end,
         source || ':' || line_start || '-' || line_end as location, 'chunk ' || vec_id as chunk, embedding::double[] as e
  from embeddings
)"""


def sql_leaf(i: int, t: float = 0.1, corpora: str = "") -> str:
    score = f"list_dot_product(e, (select embedding::double[] from embeddings where vec_id = {i}))"
    return f"(select *, {score} as score from v where {score} >= {t}{corpora and f' and corpus in ({corpora})'})"


def sql_union(*leaves: str) -> str:
    every = " union all ".join(f"select *, {i} as ord from {x}" for i, x in enumerate(leaves))
    return f"(select * exclude (n, ord) from (select *, row_number() over (partition by corpus, location order by score desc, ord) as n from ({every})) where n = 1)"


def sql_minus(a: str, b: str) -> str:
    return f"(select * from {a} a where not exists (select 1 from {b} b where b.corpus = a.corpus and b.location = a.location))"


def sql_meet(*leaves: str) -> str:
    found = " ".join(f"and exists (select 1 from {x} b where b.corpus = a.corpus and b.location = a.location)" for x in leaves)
    return f"(select * from {sql_union(*leaves)} a where true {found})"


def sql_merge(rows: str) -> str:
    by = "partition by corpus, source order by line_start, line_end, chunk_index, id"  # equal rows need an order of their own
    return f"""(select corpus, source, min(line_start) as line_start, max(line_end) as line_end, max(score) as score, string_agg(chunk, chr(10) order by line_start, line_end, chunk_index) as chunk
  from (select *, sum(opens) over ({by} rows unbounded preceding) as island
        from (select *, case when line_start <= max(line_end) over ({by} rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as opens
              from (select *, row_number() over () as id from {rows})))
  group by corpus, source, island)"""


def sql_tidy(rows: str) -> str:
    return f"with {VIEW} select corpus, location, round(score, 6) as score, chunk from {rows}"


def sql_tree(rows: str) -> str:
    return f"with {VIEW} select corpus, source || ':' || line_start || '-' || line_end as location, round(score, 6) as score, chunk from {sql_merge(rows)}"


L0, L1, L2, L3 = (sql_leaf(i) for i in range(4))


@query("vector_score_scan", f"with {VIEW} select corpus, chunk_index, round(score, 6) as score from {sql_leaf(0, -2)}")
def vector_score_scan(spark, d):
    return retrieve.score_chunks(vector_corpus(spark, d), query_vector(spark, d, 0)).select("corpus", "chunk_index", F.round("score", 6).alias("score"))


@query("min_score_filter", sql_tidy(L0))
def min_score_filter(spark, d):
    return tidy(leaf(spark, d, 0))


@query("corpus_filter", sql_tidy(sql_leaf(0, 0.1, "'c0', 'c2'")))
def corpus_filter(spark, d):
    return tidy(leaf(spark, d, 0, corpora=["c0", "c2"]))


_TOP = f"(select *, row_number() over (partition by corpus order by score desc, chunk_index) as rank from {sql_leaf(0, -2)})"


@query("topk_per_corpus", f"with {VIEW} select corpus, rank::int as rank, chunk_index, round(score, 6) as score from {_TOP} where rank <= 5")
def topk_per_corpus(spark, d):
    rows = retrieve.score_chunks(vector_corpus(spark, d), query_vector(spark, d, 0))
    return retrieve.top_k_per_corpus(rows, 5).select("corpus", "rank", "chunk_index", F.round("score", 6).alias("score"))


def vector_index(spark: SparkSession, d: str) -> cells.VectorIndex:
    return cells.VectorIndex.build(vector_corpus(spark, d), shared_path(spark, "index"), most=64)


@query("index_topk_per_corpus", f"with {VIEW} select corpus, rank::int as rank, chunk_index, round(score, 6) as score from {_TOP} where rank <= 5")
def index_topk_per_corpus(spark, d):
    """From the cells that can reach the fifth score."""
    return vector_index(spark, d).top_k_per_corpus(query_vector(spark, d, 0), 5).select("corpus", "rank", "chunk_index", F.round("score", 6).alias("score"))


@query("index_min_score", sql_tidy(sql_leaf(0, 0.3, "'c0', 'c1'")))
def index_min_score(spark, d):
    return tidy(vector_index(spark, d).search(query_vector(spark, d, 0), 0.3, ["c0", "c1"]))


@query("data_source_search", sql_tidy(sql_leaf(0, 0.1, "'c0', 'c2'")))
def data_source_search(spark, d):
    """Written and read by the library's own format; corpus and score are decided in its reader."""
    snapshot.register(spark)
    path = shared_path(spark, "chunks")
    vector_corpus(spark, d).write.format("quarry").mode("overwrite").save(path)
    rows = spark.read.format("quarry").option("vector", json.dumps(list(query_vector(spark, d, 0)))).load(path)
    found = rows.where(F.col("corpus").isin("c0", "c2") & (F.col("score") >= 0.1))
    return tidy(found.withColumn("location", text.location(F.col("source"), F.col("line_start"), F.col("line_end"))))


_TOP10 = f"(select * from {_TOP} where rank <= 5 order by score desc, corpus, chunk_index limit 10)"


@query("topk_global", sql_tidy(_TOP10))
def topk_global(spark, d):
    return tidy(retrieve.top_k(vector_corpus(spark, d), query_vector(spark, d, 0), 5))


@query("leaf_max_results", sql_tidy(f"(select * from {L1} order by score desc, corpus, chunk_index limit 7)"))
def leaf_max_results(spark, d):
    return tidy(leaf(spark, d, 1, most=7))


@query(
    "quality_gate_counts",
    f"""with {VIEW} select count(*) filter (score >= 0.3) as quality_results, count(*) filter (score < 0.3) as filtered_count, count(*) filter (score >= 0.3) >= 2 as passed,
    case when count(*) = 0 then 'No results found.' when count(*) filter (score >= 0.3) < 2 then 'Only ' || count(*) filter (score >= 0.3) || ' result(s) reach the minimum score of 0.3. Try a more specific query.' end as message from {_TOP10}""",
)
def quality_gate_counts(spark, d):
    return retrieve.quality_gate(retrieve.top_k(vector_corpus(spark, d), query_vector(spark, d, 0), 5), 0.3)


@query(
    "context_assembly",
    f"with {VIEW}, r as (select *, row_number() over (order by score desc, corpus, chunk_index) as n from {_TOP10}) select string_agg('Source ' || n || ' from ' || corpus || ' (' || location || '):' || chr(10) || chunk || chr(10) || chr(10), '' order by n) as context from r",
)
def context_assembly(spark, d):
    return retrieve.assemble_context(retrieve.top_k(vector_corpus(spark, d), query_vector(spark, d, 0), 5))


@query(
    "result_previews",
    f"with {VIEW} select row_number() over (order by score desc, corpus, chunk_index)::int as rank, corpus, location, printf('%.3f', score) as score, left(chunk, 200) as preview from {_TOP10}",
)
def result_previews(spark, d):
    return retrieve.previews(retrieve.top_k(vector_corpus(spark, d), query_vector(spark, d, 0), 5))


@query(
    "extract_report_lines",
    f"with {VIEW}, r as (select *, row_number() over (order by score desc, corpus, chunk_index) as n from {_TOP10}) select n::int as i, '[' || n || '] ' || corpus || ' - ' || location || ' (score: ' || printf('%.3f', score) || ')' || chr(10) || chunk || chr(10) as value from r",
)
def extract_report_lines(spark, d):
    return report.result_lines(retrieve.top_k(vector_corpus(spark, d), query_vector(spark, d, 0), 5))


# ---- set operators


@query("set_union_keyed", sql_tidy(sql_union(L0, L1, L2)))
def set_union_keyed(spark, d):
    p, sets = passages(spark, d, 3)
    return tidy(p.select(p.union(*sets)))


@query("set_union_frames", sql_tidy(sql_union(L0, L1, L2)))
def set_union_frames(spark, d):
    """The same of sets that come from anywhere."""
    return tidy(setops.union([leaf(spark, d, i) for i in range(3)]))


@query("set_union_all", sql_tidy(f"(select * from {L0} union all select * from {L1})"))
def set_union_all(spark, d):
    return tidy(setops.union_all([leaf(spark, d, 0), leaf(spark, d, 1)]))


@query("set_difference_exact", sql_tidy(sql_minus(L0, L1)))
def set_difference_exact(spark, d):
    p, (_, b) = passages(spark, d, 2)
    return tidy(p.rows_of(0, [b]))


@query("set_difference_frames", sql_tidy(sql_minus(L0, L1)))
def set_difference_frames(spark, d):
    return tidy(setops.difference(leaf(spark, d, 0), leaf(spark, d, 1)))


def sql_far(a: str, b: str, t: float) -> str:
    return f"(select * from {sql_minus(a, b)} a where not exists (select 1 from {b} b where list_dot_product(a.e, b.e) >= {t}))"


@query("set_difference_semantic", sql_tidy(sql_far(L0, L1, 0.35)))
def set_difference_semantic(spark, d):
    rows = scan(spark, d, [0, 1])
    return tidy(setops.semantic_difference(*[rows.where(F.col("_ord") == i).drop("_ord") for i in (0, 1)], 0.35))


@query("set_difference_semantic_blocks", sql_tidy(sql_far(L0, L1, 0.35)))
def set_difference_semantic_blocks(spark, d):
    """The way of sides too large to be sent to every task."""
    return tidy(setops.semantic_difference(leaf(spark, d, 0), leaf(spark, d, 1), 0.35, block=16))


@query("set_intersect_keyed", sql_tidy(sql_meet(L0, L1)))
def set_intersect_keyed(spark, d):
    p, (a, b) = passages(spark, d, 2)
    return tidy(p.select(p.intersect(a, b)))


@query("set_intersect_frames", sql_tidy(sql_meet(L0, L1)))
def set_intersect_frames(spark, d):
    return tidy(setops.intersect(leaf(spark, d, 0), leaf(spark, d, 1)))


@query("set_intersect_nary", sql_tidy(sql_meet(L0, L1, L2)))
def set_intersect_nary(spark, d):
    return tidy(setops.intersect_all([leaf(spark, d, i) for i in range(3)]))


@query("nested_union_minus", sql_tidy(sql_minus(sql_union(L0, L1, L2), L3)))
def nested_union_minus(spark, d):
    p, (a, b, c, e) = passages(spark, d, 4)
    return tidy(p.select(p.difference(p.union(a, b, c), e)))


@query(
    "semantic_max_similarity",
    f"with {VIEW} select a.corpus, a.chunk_index, round(max(list_dot_product(a.e, b.e)), 6) as similarity from v a, {sql_leaf(1, 0.2)} b group by all",
)
def semantic_max_similarity(spark, d):
    chunks = vector_corpus(spark, d)
    best = match.best_match(chunks, leaf(spark, d, 1, 0.2))
    return chunks.join(best, "embedding").select("corpus", "chunk_index", F.round("similarity", 6).alias("similarity"))


@query(
    "batch_search",
    "select b.vec_id as item_id, a.vec_id as doc_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where b.vec_id % 20 = 0 and list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.3",
)
def batch_search(spark, d):
    """Every twentieth vector as a query against all."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), "embedding")
    return match.close_pairs(rows.withColumnRenamed("vec_id", "doc_id"), asked, 0.3).withColumn("score", F.round("score", 6))


SQL["batch_search_by_cells"] = SQL["batch_search"]


@query("batch_search_by_cells")
def batch_search_by_cells(spark, d):
    """The way of more queries than can be sent to every task."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), "embedding")
    return match.close_pairs_by_cells(rows.withColumnRenamed("vec_id", "doc_id"), asked, 0.3, block=256).withColumn("score", F.round("score", 6))


# ---- trees and SQL


def run_sql(statement: str) -> Query:
    return lambda spark, d: tidy(tree.lower(dialect.parse(statement), tree_search(spark, d)))


def q(i: int) -> str:
    return f"SELECT * FROM search('query {i}')"


for _name, _statement, _rows in [
    ("sql_union", f"{q(0)} UNION {q(1)} WHERE min_score >= 0.1", sql_union(L0, L1)),
    ("sql_union_all", f"{q(0)} UNION ALL {q(1)} UNION ALL {q(0)} WHERE min_score >= 0.1", f"(select * from {L0} union all select * from {L1} union all select * from {L0})"),
    ("sql_except_all", f"({q(0)} UNION ALL {q(0)}) EXCEPT ALL {q(1)} WHERE min_score >= 0.1", f"(select * from {L0} union all select * from {sql_minus(L0, L1)})"),
    ("sql_except", f"{q(0)} EXCEPT {q(1)} where min_score >= 0.1", sql_minus(L0, L1)),
    ("sql_intersect", f"{q(0)} INTERSECT {q(1)} WHERE min_score >= 0.1", sql_meet(L0, L1)),
    ("sql_semantic_except", f"{q(0)} EXCEPT {q(1)} WHERE min_score >= 0.1 AND semantic = true AND threshold >= 0.35", sql_far(L0, L1, 0.35)),
    (
        "sql_nested_where",
        f"SELECT * FROM ({q(0)} UNION {q(1)}) t EXCEPT ({q(2)} INTERSECT {q(3)}) WHERE corpus IN ('c0', 'c1') AND min_score >= 0.1",
        sql_minus(sql_union(*(sql_leaf(i, 0.1, "'c0', 'c1'") for i in (0, 1))), sql_meet(*(sql_leaf(i, 0.1, "'c0', 'c1'") for i in (2, 3)))),
    ),
]:
    query(_name, sql_tree(_rows))(run_sql(_statement))


@query("json_nested", sql_tree(sql_minus(sql_union(L0, sql_meet(L1, L2)), L3)))
def json_nested(spark, d):
    spec = {
        "op": "difference",
        "left": {"op": "union", "queries": ["query 0", {"op": "intersect", "queries": ["query 1", "query 2"]}]},
        "right": {"query": "query 3"},
        "min_score": 0.1,
    }
    return tidy(tree.lower(spec, tree_search(spark, d)))


_TREES = [
    ({"op": "union", "queries": [f"query {i}", f"query {i + 1}"]}, sql_union(sql_leaf(i), sql_leaf(i + 1))) for i in range(4)
] + [
    ({"op": "difference", "left": {"op": "union", "queries": ["query 0", f"query {i}"]}, "right": f"query {i + 1}"}, sql_minus(sql_union(L0, sql_leaf(i)), sql_leaf(i + 1))) for i in range(1, 4)
] + [
    ({"op": "intersect", "queries": ["query 0", f"query {i}"]}, sql_meet(L0, sql_leaf(i))) for i in range(1, 4)
]


@query("ten_trees", f"with {VIEW} " + " union all ".join(f"select {i} as tree, corpus, location, round(score, 6) as score, chunk from {rows}" for i, (_, rows) in enumerate(_TREES)))
def ten_trees(spark, d):
    """Ten trees over five searches by one scan and one shuffle."""
    rows = tree.lower_many([t | {"min_score": 0.1} for t, _ in _TREES], tree_search(spark, d))
    return rows.select("tree", "corpus", "location", F.round("score", 6).alias("score"), "chunk")


@query("boolean_flags", sql_tree(sql_minus(sql_union(L0, L1), sql_union(L2, L3))))
def boolean_flags(spark, d):
    spec = tree.boolean_query("query 0, query 1", exclude=["query 2", "query 3"], union=True, min_score=0.1)
    return tidy(tree.lower(spec, tree_search(spark, d)))


@query(
    "spark_sql_search_function",
    f"with {VIEW} select corpus, count(*) as hits, round(max(score), 6) as best from {L0} group by corpus",
)
def spark_sql_search_function(spark, d):
    """Search as a table function of plain Spark SQL, where any clause may follow."""
    known = {"query 0": query_vector(spark, d, 0)}
    vector_corpus(spark, d).createOrReplaceTempView("quarry_chunks")
    retrieve.register_search(spark, "quarry_search", "quarry_chunks", known.__getitem__)
    return spark.sql("SELECT corpus, count(*) AS hits, round(max(score), 6) AS best FROM quarry_search('query 0') WHERE score >= 0.1 GROUP BY corpus")


@query("top_k_table_function", SQL["topk_per_corpus"])
def top_k_table_function(spark, d):
    """A table function over a table, partitioned by corpus; parts of each corpus first."""
    known = {"query 0": query_vector(spark, d, 0)}
    vector_corpus(spark, d).createOrReplaceTempView("quarry_chunks")
    tablefunction.register_top_k(spark, "quarry_top_k", known.__getitem__)
    rows = spark.sql(tablefunction.top_k_statement("quarry_top_k", "quarry_chunks", "query 0", 5))
    return rows.select("corpus", "rank", "chunk_index", F.round("score", 6).alias("score"))


# ---- document order


@query("document_order", sql_tidy(sql_union(L0, L1)))
def document_order(spark, d):
    p, sets = passages(spark, d, 2)
    return tidy(docorder.document_order(p.select(p.union(*sets))))


@query("merge_adjacent", sql_tree(sql_union(L0, L1, L2)))
def merge_adjacent(spark, d):
    p, sets = passages(spark, d, 3)
    return tidy(docorder.merge_adjacent(p.select(p.union(*sets))))


@query("merge_adjacent_blocks", SQL["merge_adjacent"])
def merge_adjacent_blocks(spark, d):
    """A file in blocks of fewer lines than its islands have."""
    p, sets = passages(spark, d, 3)
    return tidy(docorder.merge_adjacent(p.select(p.union(*sets)), lines=15))


@query("interval_union", f"with {VIEW} select corpus, source, line_start, line_end from {sql_merge(sql_union(L0, L1, L2))}")
def interval_union(spark, d):
    p, sets = passages(spark, d, 3)
    return docorder.interval_union(p.select(p.union(*sets)))


_SUMMARY = "count(*) as total_chunks, count(distinct corpus || source) as n_sources, round(coalesce(min(score), 0), 6) as min_score, round(coalesce(max(score), 0), 6) as max_score"


@query("extract_summary", f"with {VIEW} select {_SUMMARY} from {L0}")
def extract_summary(spark, d):
    return retrieve.extraction_summary(leaf(spark, d, 0)).withColumns({c: F.round(c, 6) for c in ("min_score", "max_score")})


@query("score_range", f"with {VIEW} select {_SUMMARY} from {sql_leaf(0, 1.5)}")
def score_range(spark, d):
    return retrieve.extraction_summary(leaf(spark, d, 0, 1.5)).withColumns({c: F.round(c, 6) for c in ("min_score", "max_score")})


@query("sources_grouped", f"with {VIEW} select corpus, source, count(*) as chunks, round(max(score), 6) as best from {L0} group by all")
def sources_grouped(spark, d):
    return retrieve.by_source(leaf(spark, d, 0)).withColumn("best", F.round("best", 6))


@query("score_statistics", f"with {VIEW} select corpus, round(avg(score), 6) as avg_score, round(max(score), 6) as max_score, round(min(score), 6) as min_score from {L0} group by corpus")
def score_statistics(spark, d):
    return retrieve.score_statistics(leaf(spark, d, 0), ["corpus"]).withColumns({c: F.round(c, 6) for c in ("avg_score", "max_score", "min_score")})


# ---- the text corpus


def text_corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("corpus"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), "text", "doc_id")


@query("lines_explode", "select source as corpus, 'doc_' || doc_id as source, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as text from documents")
def lines_explode(spark, d):
    return chunk.explode_lines(text_corpus(spark, d))


@query("token_estimate", r"select doc_id, floor(len(list_filter(string_split_regex(text, '[\s\x1c-\x1f\x85\xa0]+'), lambda x: x <> '')) * 3.5)::int as tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("long_lines", r"select source as corpus, count(*) as lines from (select source, unnest(string_split(text, chr(10))) as line from documents) where floor(len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) * 3.5) > 128 group by source")
def long_lines(spark, d):
    """Lines that the chunker has to split."""
    lines = chunk.explode_lines(text_corpus(spark, d))
    return lines.where(text.estimate_tokens(F.col("text")) > 128).groupBy("corpus").agg(F.count("*").alias("lines"))


_SPLIT = r"\s\x1c-\x1f\x85\xa0"  # white space as words are split at


@query(
    "chunk_text",
    # the fold over a document's lines: first line of each line's chunk, -1 for a line to be split
    rf"""with lines as (
  select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as n from documents
), sized as (
  select *, list_filter(string_split_regex(line, '[{_SPLIT}]+'), lambda w: w <> '') as words, floor(len(words) * 3.5)::int as tokens from lines
), per as (
  select doc_id, source, list(tokens order by n) as ts from sized group by all
), folded as (
  select doc_id, list_reduce(list_transform(ts, lambda x: {{'held': 0, 'tokens': x, 'starts': []::int[]}}), lambda a, x: 
     case when x.tokens > 128 then {{'held': 0, 'tokens': 0, 'starts': list_append(a.starts, -1)}}
          when a.held > 0 and a.tokens + x.tokens > 128 then {{'held': 1, 'tokens': x.tokens, 'starts': list_append(a.starts, len(a.starts)::int + 1)}}
          else {{'held': a.held + 1, 'tokens': a.tokens + x.tokens, 'starts': list_append(a.starts, case when a.held = 0 then len(a.starts)::int + 1 else a.starts[-1] end)}} end,
     {{'held': 0, 'tokens': 0, 'starts': []::int[]}}).starts as starts from per
), placed as (
  select s.*, f.starts[s.n] as start from sized s join folded f using (doc_id)
), pieces as (
  select doc_id, source, start as line_start, max(n) as line_end, 0 as piece, string_agg(line, chr(10) order by n) as chunk from placed where start > 0 group by doc_id, source, start
  union all
  select doc_id, source, n, n, i, array_to_string(words[i + 1:i + 42], ' ') from (select *, unnest(range(0, len(words), 42)) as i from placed where start < 0)
)
select source as corpus, 'doc_' || doc_id as source, row_number() over (partition by doc_id order by line_start, piece)::int - 1 as chunk_index, line_start::int as line_start, line_end::int as line_end, chunk
from pieces where regexp_matches(chunk, '[^{_SPLIT}]')""",
)
def chunk_text(spark, d):
    return chunk.chunk_documents(text_corpus(spark, d), 128)


_JOINED = "(select source as doc_id, source, string_agg(coalesce(text, ''), chr(10) order by doc_id) || chr(10) as text from documents group by source)"


@query("chunk_split_files", f"select corpus, chunk_index, line_start, line_end, chunk from ({SQL['chunk_text'].replace('from documents', f'from {_JOINED}')})")
def chunk_split_files(spark, d):
    """The documents of each source as one text file, read by byte ranges and chunked in blocks of 64 KB."""
    path = shared_path(spark, "texts")
    said = table(spark, d, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    said.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").option("lineSep", "\n").text(path)
    rows = splits.chunk_files(spark, [path], 128, block_bytes=1 << 16)
    return rows.withColumn("corpus", F.regexp_extract("path", "source=([^/]*)", 1)).drop("path")


@query("rebuild_text", r"select source as corpus, 'doc_' || doc_id as source, array_to_string(list_transform(string_split(text, chr(10))[2:4], lambda x: x || chr(10)), '') || case when len(string_split(text, chr(10))) >= 7 then chr(10) || array_to_string(list_transform(string_split(text, chr(10))[7:8], lambda x: x || chr(10)), '') else '' end as content from documents where len(string_split(text, chr(10))) >= 2")
def rebuild_text(spark, d):
    """Lines 2-4 and 7-8 of every document, from overlapping ranges."""
    docs = text_corpus(spark, d)
    ranges = docs.select("corpus", "source", F.explode(F.expr("array(struct(2 as line_start, 3 as line_end), struct(3 as line_start, 4 as line_end), struct(7 as line_start, 8 as line_end))")).alias("r")).select("corpus", "source", "r.*", F.col("r.line_start").alias("chunk_index"))
    return docorder.rebuild_text(chunk.explode_lines(docs), docorder.interval_union(ranges))


@query("rebuild_long_ranges", "select source as corpus, 'doc_' || doc_id as source, text || chr(10) as content from documents where text is not null")
def rebuild_long_ranges(spark, d):
    """Every document by one range of a million lines, cut at bins."""
    docs = text_corpus(spark, d)
    ranges = docs.select("corpus", "source", F.lit(1).alias("line_start"), F.lit(1_000_000).alias("line_end"))
    return docorder.rebuild_text(chunk.explode_lines(docs), ranges, bin_lines=16_384)


@query("hash_embed_search")
def hash_embed_search(spark, d):
    return match.search_texts(table(spark, d, "documents"), table(spark, d, "benchmark"), 0.9, embedding.HashedWords()).withColumn("score", F.round("score", 6))


_HASHED = "select {key}, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as bucket, count(*) as n from (select {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as w from {table}) group by all"
SQL["hash_embed_search"] = f"""with a as ({_HASHED.format(key='doc_id', table='documents')}), b as ({_HASHED.format(key='item_id', table='benchmark')}),
 an as (select doc_id, sqrt(sum(n * n)) as norm from a group by all), bn as (select item_id, sqrt(sum(n * n)) as norm from b group by all)
select * from (select item_id, doc_id, round(sum(a.n * b.n) / (an.norm * bn.norm), 6) as score from a join b using (bucket) join an using (doc_id) join bn using (item_id) group by item_id, doc_id, an.norm, bn.norm) where score >= 0.9"""


@query("l2_normalize", "select vec_id, round((embedding::double[])[1] / n, 6) as first, round((embedding::double[])[64] / n, 6) as last, 1.0::double as norm from (select *, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)")
def l2_normalize(spark, d):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    units = table(spark, d, "embeddings").select("vec_id", vector.l2_normalize(tripled).alias("u"))
    return units.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"), F.round(F.sqrt(vector.dot(F.col("u"), F.col("u"))), 6).alias("norm"))


_WS = r" \t\r\f\v\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STEPS = [  # (pattern, replacement), in order; every match of each
    (r"[\x{0591}-\x{05C7}\x{05F3}\x{05F4}]", ""), (r"\x{00AD}", ""), (r"[\x{200B}-\x{200D}\x{FEFF}]", ""), (r"[^\P{C}\n\t]", ""),
    (" {2,}", " "), (rf"[{_WS}]+(\n|$)", r"\1"), (r"\n{3,}", "\n\n"), (r" +([.,;:!?])", r"\1"), (rf"(?m)^[{_WS}\n]*[•·∙●○◦▪▫■□▬▭▮▯◆◇◈◊][{_WS}\n]+", "- "),
]
_NORMAL = "text"
for _pattern, _new in _STEPS:
    _NORMAL = f"regexp_replace({_NORMAL}, '{_pattern}', '{_new}', 'g')"


@query("normalize_text", rf"select doc_id, regexp_replace(nfc_normalize({_NORMAL}), '^[{_WS}\n]+|[{_WS}\n]+$', '', 'g') as text from documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


_COUNTS = "length(regexp_replace(text, '[^\\x{0590}-\\x{05FF}]', '', 'g')) as h, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as e"


_ALPHABET, _HEBREW = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x5D0, 0x5EA)))
_SPELT = f"translate(lower(regexp_replace(text, '[^a-zA-Z \\n]', '', 'g')), '{_ALPHABET}', '{_HEBREW}')"


@query(
    "bidi_visual_order",
    f"""select doc_id, array_to_string(list_transform(list_transform(string_split({_SPELT}, chr(10)), lambda x: [regexp_extract(x, '^ *'), trim(x, ' '), regexp_extract(x, '[^ ]( *)$', 1)]),
      lambda p: 'No. 1: ' || p[1] || reverse(p[2]) || p[3]), chr(10)) as text from documents""",
)
def bidi_visual_order(spark, d):
    """Every document spelt in Hebrew letters, each line behind a Latin heading."""
    spelt = F.translate(F.lower(F.regexp_replace("text", r"[^a-zA-Z \n]", "")), _ALPHABET, _HEBREW)
    lines = F.regexp_replace(F.concat(F.lit("No. 1: "), spelt), "\n", "\nNo. 1: ")
    return table(spark, d, "documents").select("doc_id", bidi.visual_order(lines).alias("text"))


@query("detect_language", f"select doc_id, case when h > e then 'hebrew' when e > 0 then 'english' else 'unknown' end as language, case when h * 10 > h + e and e * 10 > h + e then 'hebrew,english' when h * 10 > h + e then 'hebrew' when e * 10 > h + e then 'english' else 'unknown' end as detected from (select doc_id, {_COUNTS} from documents)")
def detect_language(spark, d):
    found = text.detect_languages(F.col("text"))
    return table(spark, d, "documents").select("doc_id", found["language"].alias("language"), F.array_join(found["detected"], ",").alias("detected"))


@query("ocr_lang_code", f"select lang, case when h * 10 > h + e and e * 10 > h + e then 'heb+eng' when h * 10 > h + e then 'heb' else 'eng' end as ocr, count(*) as n from (select lang, {_COUNTS} from documents) group by all")
def ocr_lang_code(spark, d):
    code = text.ocr_language(text.detect_languages(F.col("text"))["detected"])
    return table(spark, d, "documents").groupBy("lang", code.alias("ocr")).agg(F.count("*").alias("n"))


@query("safe_filename", r"select page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^\w \-.]', '', 'g'), '\.[^.]*$', '') || '.md' as name from pages")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("location_parse", "select conv_id, turn, role as source, turn::int as line_start, (turn + length(text))::int as line_end from conversations")
def location_parse(spark, d):
    said = table(spark, d, "conversations").withColumn("location", text.location(F.col("role"), F.col("turn"), F.col("turn") + F.length("text")))
    return said.select("conv_id", "turn", text.parse_location(F.col("location")).alias("p")).select("conv_id", "turn", "p.*")


@query("comma_list", "select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') as parts from documents")
def comma_list(spark, d):
    return table(spark, d, "documents").select("doc_id", text.comma_list(F.col("text")).alias("parts"))


@query("markdown_front_matter", r"select page_id, '---' || chr(10) || 'source: ' || regexp_extract(url, '([^/]*)$', 1) || chr(10) || 'pages: 1' || chr(10) || 'characters: ' || length(html) || chr(10) || '---' || chr(10) as header from pages")
def markdown_front_matter(spark, d):
    fields = [("source", F.regexp_extract("url", "([^/]*)$", 1)), ("pages", F.lit(1)), ("characters", F.length("html"))]
    return table(spark, d, "pages").select("page_id", text.front_matter(fields).alias("header"))


@query("page_separators", r"select page_id, printf('%s---%s**Page %d**%s---%s', chr(10) || chr(10), chr(10), page_id, chr(10), chr(10) || chr(10)) as separator from pages")
def page_separators(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_separator(F.col("page_id")).alias("separator"))


@query(
    "conversion_stats",
    """with f as (select case when lang = 'es' then null else text end as text, lang, doc_id % 4 + 1 as pages, n_chars / 1000.0::double as seconds, lang = 'es' and doc_id % 2 = 0 as skipped from documents)
    select count(*) filter (text is not null) as converted, count(*) filter (text is null and not skipped) as failed, count(*) filter (skipped) as skipped, coalesce(sum(pages) filter (text is not null), 0)::bigint as pages,
    coalesce(sum(length(text)), 0)::bigint as characters, avg(length(text)) as avg_characters, round(coalesce(sum(seconds) filter (text is not null), 0), 3) as seconds,
    round(sum(seconds) filter (text is not null) / count(*) filter (text is not null), 6) as seconds_per_file, round(sum(seconds) filter (text is not null) / sum(pages) filter (text is not null), 6) as seconds_per_page from f""",
)
def conversion_stats(spark, d):
    """Spanish documents stand for those that fail, every other of them for one that is skipped."""
    bad = F.col("lang") == "es"
    done = table(spark, d, "documents").select(
        F.when(~bad, F.col("text")).alias("text"), (F.col("doc_id") % 4 + 1).alias("pages"), F.when(bad, "error").alias("error"), (bad & (F.col("doc_id") % 2 == 0)).alias("skipped"), (F.col("n_chars") / 1000.0).alias("seconds"),
    )
    return convert.conversion_stats(done).withColumns({"seconds": F.round("seconds", 3), "seconds_per_file": F.round("seconds_per_file", 6), "seconds_per_page": F.round("seconds_per_page", 6)})


_PAGE = "html"
for _pattern, _new in [
    (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " "), (r"(?i)<(?:br|/p|/h[1-6]|/div|/li|/tr)\b[^>]*>", "\n"), ("<[^>]*>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
    ("&nbsp;", " "), ("&amp;", "&"), (r"[ \t\r]+", " "), (" ?\n ?", "\n"), ("\n{2,}", "\n"), (r"^\s+|\s+$", ""),
]:
    _PAGE = f"regexp_replace({_PAGE}, '{_pattern}', '{_new}', 'g')"
_HEADER = [("source", "name"), ("pages", "1"), ("language", "language"), ("detected_languages", "array_to_string(detected_languages, ', ')"), ("converted", "'2026-01-02T03:04:05'"), ("method", "'html'"), ("characters", "length(text)")]
_LINES = " || ".join(f"'{k}: ' || coalesce(({v})::varchar, '') || chr(10)" for k, v in _HEADER)


@query(
    "convert_pages",
    rf"""with p as (select '/pages/' || page_id || '.html' as path, page_id || '.html' as name, {_PAGE} as text from pages),
    c as (select *, length(regexp_replace(text, '[^\x{{0590}}-\x{{05FF}}]', '', 'g')) as h, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as e from p),
    l as (select *, case when h > e then 'hebrew' when e > 0 then 'english' else 'unknown' end as language,
      case when h * 10 > h + e and e * 10 > h + e then ['hebrew', 'english'] when h * 10 > h + e then ['hebrew'] when e * 10 > h + e then ['english'] else ['unknown'] end as detected_languages from c)
    select path, '.html' as format, text, 1 as pages, null::varchar as error, language, detected_languages,
    '---' || chr(10) || {_LINES} || '---' || chr(10) || chr(10) || '# ' || name || chr(10) || chr(10) || text || chr(10) as markdown, regexp_replace(name, '\.[^.]*$', '') || '.md' as file_name from l""",
)
def convert_pages(spark, d):
    """Web pages as one more input format: Markdown files with metadata."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit(".html").alias("format"), convert.page_text(F.col("html")).alias("text"), F.lit(1).alias("pages"), F.lit(None).cast("string").alias("error"))
    return convert.describe(pages, F.lit("2026-01-02 03:04:05").cast("timestamp"))


@query("pdf_text_layer", r"select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') as text from documents".replace("\\\\", "\\"))
def pdf_text_layer(spark, d):
    """Every document as a PDF, in one of three forms, and its text read back from the pages."""

    def written(texts: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([pdf_write.write_pdf(t or "", f) for t, f in zip(texts.to_pylist(), forms.to_pylist(), strict=True)], pa.binary())

    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 3).cast("int").alias("form"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.arrow_udf(written, "binary")("text", "form").alias("content"))
    pages = F.array_sort(F.collect_list(F.struct("page", "text")))  # of one file
    said = pdf.read_pages(files).groupBy("path").agg(F.array_join(F.transform(pages, lambda p: p["text"]), "\n").alias("text"))
    return said.select(F.col("path").cast("long").alias("doc_id"), F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("text"))


# ---- catalog


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """A catalog with a corpus for each source of the documents."""
    return table(spark, d, "documents").groupBy(F.col("source").alias("corpus")).agg(
        F.count("*").alias("chunk_count"), F.sum("n_chars").alias("file_size"), F.lit("hashed-words-64").alias("embedding_model"), F.lit(64).alias("embedding_dim"),
        F.lit("inner product").alias("index_type"), (F.max("doc_id") % 2 == 0).alias("normalized"),
    )


_MANIFEST = "m as (select source as corpus, count(*) as chunk_count, sum(n_chars)::bigint as file_size, 'hashed-words-64' as embedding_model, 64 as embedding_dim, 'inner product' as index_type, max(doc_id) % 2 = 0 as normalized from documents group by source)"


@query("catalog_list", f"with {_MANIFEST} select corpus from m")
def catalog_list(spark, d):
    return catalog.listing_of(manifest(spark, d))


@query("corpus_info_counts", f"with {_MANIFEST} select corpus, chunk_count, file_size from m")
def corpus_info_counts(spark, d):
    return catalog.totals(manifest(spark, d)).select("corpus", "chunk_count", "file_size")


@query("compatibility_check", f"with {_MANIFEST} select count(distinct corpus) as corpora, count(distinct normalized) as settings from m")
def compatibility_check(spark, d):
    return catalog.setting_conflicts(manifest(spark, d))


@query("incremental_skip", "select doc_id, source, n_chars from documents where doc_id % 3 = 0 or n_chars % 2 = 1")
def incremental_skip(spark, d):
    """Documents whose manifest row is new or differs from the stored one: every third is not stored, odd sizes were other."""
    now = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    stored = now.where("doc_id % 3 <> 0").withColumn("n_chars", F.when(F.col("n_chars") % 2 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return catalog.stale_rows(now, stored, ["doc_id", "source", "n_chars"])


def entry(spark: SparkSession) -> DataFrame:
    return topk_global(spark, "/root/testdata/sf0.001" if Path("/root/testdata").exists() else "testdata")
