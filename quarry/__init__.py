"""Semantic retrieval and corpus preparation as Spark plans."""

from quarry.engine import Engine
from quarry.functions.embedding import Embedder, HashedWords, TooLong, embed
from quarry.functions.text import detect_languages, estimate_tokens, normalize_text, ocr_language
from quarry.operators.chunk import chunk_documents
from quarry.operators.docorder import document_order, interval_union, merge_adjacent, rebuild_text
from quarry.operators.match import best_match, close_pairs, search_texts
from quarry.operators.retrieve import quality_gate, search_many, search_rows, top_k
from quarry.operators.setops import difference, intersect, intersect_all, semantic_difference, union, union_all
from quarry.plans.sql import parse
from quarry.plans.tree import boolean_query, lower
from quarry.sources.catalog import Catalog, read_texts
from quarry.sources.convert import conversion_stats, convert, read_files, register

__all__ = [
    "Catalog", "Embedder", "Engine", "HashedWords", "TooLong", "best_match", "boolean_query", "chunk_documents", "close_pairs", "conversion_stats", "convert",
    "detect_languages", "difference", "document_order", "embed", "estimate_tokens", "intersect", "intersect_all", "interval_union", "lower", "merge_adjacent",
    "normalize_text", "ocr_language", "parse", "quality_gate", "read_files", "read_texts", "rebuild_text", "register", "search_many", "search_rows", "search_texts",
    "semantic_difference", "top_k", "union", "union_all",
]
