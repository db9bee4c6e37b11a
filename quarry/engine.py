"""One object for the whole: index, search, boolean and SQL queries, extraction, answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.embedding import Embedder, embed_query
from quarry.operators import docorder, report, retrieve
from quarry.operators.chunk import explode_lines
from quarry.plans import sql as dialect
from quarry.plans import tree
from quarry.sources.catalog import Catalog, Inputs, input_error, pairs_of, read_texts

Generator = Callable[[str], str]
PROMPT = "{context}\nQuestion: {question}\nAnswer:"


def first_lines(prompt: str) -> str:
    """Answers without a model: the first line of each source of the prompt."""
    blocks = prompt.split("Source ")[1:]
    return "\n".join(lines[1] for lines in (b.split("\n") for b in blocks) if len(lines) > 1)


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, generator: Generator = first_lines, prompt: str = PROMPT):
        self.spark, self.generator, self.prompt = spark, generator, prompt
        self.catalog = Catalog(spark, root, embedder)

    def index(self, inputs: Inputs, size: int | None = None) -> DataFrame:
        """Catalog rows of the files that were new or changed. `inputs` are paths, each a corpus by its stem, or {corpus: path or paths}; what is no file is refused."""
        return self.catalog.index(read_texts(self.spark, inputs), size)

    def index_large(self, paths: Sequence[str], size: int | None = None) -> DataFrame:
        """As `index`, for text files of any size, which are read by byte ranges."""
        return self.catalog.index_large(paths, size)

    def index_each(self, inputs: Inputs, size: int | None = None) -> DataFrame:
        """corpus, file_path, chunk_count, error of what was indexed and of each input that could not be; none stops the others."""
        pairs = [(corpus, path, input_error(self.spark, path)) for corpus, path in pairs_of(inputs)]
        bad = self.spark.createDataFrame([(c, p, 0, e) for c, p, e in pairs if e], "corpus string, file_path string, chunk_count long, error string")
        good = [(c, p) for c, p, e in pairs if not e]
        if not good:
            return bad
        if isinstance(inputs, Mapping):
            named = {corpus: [p for c, p in good if c == corpus] for corpus, _ in good}
        else:
            named = [p for _, p in good]
        return self.index(named, size).select("corpus", "file_path", "chunk_count", "error").unionByName(bad)

    def register_search(self, name: str = "search") -> None:
        """`name('text')` as a table function of Spark SQL over all corpora, with any clause around it."""
        self.catalog.chunks().createOrReplaceTempView(f"{name}_chunks")
        embedder = self.catalog.embedder
        retrieve.register_search(self.spark, name, f"{name}_chunks", lambda text: embed_query(text, embedder))

    def _corpora(self, corpora: Sequence[str] | None) -> list[str]:
        names = list(corpora) if corpora else [r["corpus"] for r in self.catalog.listing().collect()]
        if not names:
            raise ValueError("no corpora are indexed")
        self.catalog.compatible(names)
        return names

    def vector(self, text: str) -> list[float]:
        """The query's unit vector; texts over the context length are refused with a size that would fit."""
        tokens, limit = int(len(text.split()) * 3.5), self.catalog.context_length
        if tokens > limit:
            raise ValueError(f"query has about {tokens} tokens, over {limit}; cut it to about {int(limit * len(text) / tokens * 0.9)} characters")
        return embed_query(text, self.catalog.embedder)

    def rows(self, text: str, corpora: Sequence[str] | None = None, min_score: float | None = 0.3, max_results: int | None = None) -> DataFrame:
        return retrieve.search_rows(self.catalog.chunks(), self.vector(text), self._corpora(corpora), min_score, max_results)

    def search(self, text: str, corpora: Sequence[str] | None = None, top_k: int = 5, min_score: float | None = 0.3) -> dict[str, Any]:
        """Answer with sources; `sources` are all top rows, the answer uses those that reach `min_score`."""
        top = retrieve.top_k(self.catalog.chunks(), self.vector(text), top_k, self._corpora(corpora)).drop("embedding").persist()
        gate = retrieve.quality_gate(top, min_score).first()
        sources = [r.asDict() for r in top.collect()]  # at most 2 * top_k
        answer = gate["message"]
        if gate["passed"]:
            good = top if min_score is None else top.where(F.col("score") >= min_score)
            answer = self.answer(text, good)
        top.unpersist()
        return {"answer": answer, "sources": sources, "quality_results": gate["quality_results"], "filtered_count": gate["filtered_count"]}

    def answer(self, text: str, rows: DataFrame, most: int = 20) -> str:
        """The generator's answer from the `most` best rows; a prompt holds no more."""
        best = rows.orderBy(F.desc("score"), "corpus", "chunk_index").limit(most)
        return self.generator(self.prompt.format(context=retrieve.assemble_context(best).first()["context"], question=text))

    def query(self, spec: Any) -> DataFrame:
        def search(texts: list[str], o: dict[str, Any]) -> DataFrame:
            return retrieve.search_many(self.catalog.chunks(), [self.vector(t) for t in texts], self._corpora(o["corpuses"]), o["min_score"], o["max_results"])

        return tree.lower(spec, search)

    def sql(self, text: str) -> DataFrame:
        return self.query(dialect.parse(text))

    def extract(
        self, text: str, output: str, texts: DataFrame | None = None, corpora: Sequence[str] | None = None, min_score: float = 0.3, max_chunks: int | None = None
    ) -> DataFrame:
        """Writes the extraction report (none if it is empty) and returns its summary. `texts` (see read_texts) are the sources to rebuild from; else chunks are."""
        rows = self.rows(text, corpora, min_score, max_chunks).drop("embedding")
        lines = explode_lines(texts) if texts is not None else self.chunk_lines()
        contents = docorder.rebuild_text(lines, docorder.interval_union(rows))
        report.write_report(report.extraction_report(rows, contents, text, self._corpora(corpora), min_score), output)
        return retrieve.extraction_summary(rows)

    def chunk_lines(self) -> DataFrame:
        said = self.catalog.chunks().select("corpus", "source", "line_start", F.posexplode(F.split("chunk", "\n")).alias("at", "text"))
        return said.select("corpus", "source", (F.col("line_start") + F.col("at")).alias("line_no"), "text")
