"""Schemas of the tables that operators pass around, as DDL."""

CHUNKS = "corpus string, file string, source string, chunk_index int, line_start int, line_end int, chunk string, embedding array<float>"
CORPORA = (
    "corpus string, file string, source string, file_path string, file_modified timestamp, file_size bigint, embedding_model string, embedding_dim int,"
    " index_type string, normalized boolean, context_length int, chunk_size int, chunk_count bigint, error string, run string"
)
#: Columns of a result row; `embedding` rides along while a semantic difference may need it.
RESULT = ["corpus", "source", "chunk_index", "line_start", "line_end", "location", "score", "chunk"]
#: Two results are the same passage when these agree.
KEY = ["corpus", "location"]


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
