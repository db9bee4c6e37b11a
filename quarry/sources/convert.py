"""Documents to Markdown. DOCX and PDF text layers need the standard library alone; OCR is a plug-in.

A converter takes the bytes of a file and gives (text, metadata). Files come as
`binaryFile` rows, so conversion is spread over the cluster; what fails is a row
with its error. `@register(".ext")` adds a format.
"""

from __future__ import annotations

import inspect
import io
import time
import zipfile
from collections.abc import Callable
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import detect_languages, front_matter, normalize_text, safe_file_name
from quarry.sources import pdf

CONVERTERS: dict[str, Callable[[bytes], tuple[str, int]]] = {}
# Fixed value: the namespace of word-processing documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def register(extension: str):
    def add(fn):
        CONVERTERS[extension] = fn
        return fn

    return add


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t"))


def _table(table) -> str:
    rows = [[" ".join(_text(c).split()) for c in row.iter(f"{W}tc")] for row in table.iter(f"{W}tr")]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    if len(rows) > 1:
        lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
    return "\n".join(lines)


@register(".docx")
def docx(data: bytes) -> tuple[str, int]:
    """Paragraphs, headings and tables in the order of the body; pages are counted as headings, at least one."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{W}body")
    out, sections = [], 0
    for node in body if body is not None else []:
        if node.tag == f"{W}tbl":
            out.append(_table(node))
        elif node.tag == f"{W}p" and _text(node).strip():
            style = node.find(f"{W}pPr/{W}pStyle")
            name = "" if style is None else style.get(f"{W}val", "")
            if name.lower().startswith("heading"):
                level = name[7:].strip()
                sections += 1
                out.append("#" * (int(level) if level.isdigit() and int(level) else 2) + " " + _text(node).strip())
            else:
                out.append(_text(node))
    return "\n\n".join(out), max(1, sections)


@register(".txt")
def plain(data: bytes) -> tuple[str, int]:
    return data.decode(), 1


register(".pdf")(pdf.pdf)


def format_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


class Skipped(ValueError):
    """A file that no converter takes."""


def options_of(converter: Callable, options: dict[str, Any]) -> dict[str, Any]:
    """Those of `options` that a converter names among its parameters, as `dpi` of one that reads scans."""
    return {k: v for k, v in options.items() if k in inspect.signature(converter).parameters}


def convert(files: DataFrame, normalize: bool = True, **options: Any) -> DataFrame:
    """files (path, content) -> path, format, text, pages, error, skipped, seconds, language, detected_languages, markdown, file_name. Each converter gets the options that it knows."""
    known = {kind: (fn, options_of(fn, options)) for kind, fn in CONVERTERS.items()}

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
                began, out, error = time.perf_counter(), (None, None), None
                try:
                    if kind not in known:
                        raise Skipped(f"unsupported format: {kind or 'none'}")
                    fn, own = known[kind]
                    out = fn(content, **own)
                    if not out[0].strip():
                        raise ValueError("no text found")
                except Exception as problem:  # the file's row says what was wrong with it
                    out, error = (None, None), problem
                rows.append((path, kind, *out, None if error is None else f"{type(error).__name__}: {error}", isinstance(error, Skipped), time.perf_counter() - began))
            names = ["path", "format", "text", "pages", "error", "skipped", "seconds"]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    found = files.mapInArrow(run, "path string, format string, text string, pages int, error string, skipped boolean, seconds double")
    return describe(found.withColumn("text", normalize_text(F.col("text"))) if normalize else found)


def describe(texts: DataFrame, now: Column | None = None) -> DataFrame:
    """texts (path, format, text, pages, error, ...) with language, and the Markdown file each becomes; `now` is the time of conversion in its header."""
    converted = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss")
    given = texts.columns
    texts = texts.withColumn("_l", detect_languages(F.col("text")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    header = front_matter(
        [
            ("source", name),
            ("pages", F.col("pages")),
            ("language", F.col("_l.language")),
            ("detected_languages", F.array_join("_l.detected", ", ")),
            ("converted", converted),
            ("method", F.regexp_replace("format", "^\\.", "")),
            ("characters", F.length("text")),
        ]
    )
    return texts.select(
        *given, F.col("_l.language").alias("language"), F.col("_l.detected").alias("detected_languages"),
        F.concat(header, F.lit("\n# "), name, F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("markdown"), safe_file_name(name).alias("file_name"),
    )


def conversion_stats(converted: DataFrame) -> DataFrame:
    """One row: files converted, failed and skipped, and pages, characters and seconds of those converted, with averages by file and page."""
    good = F.col("error").isNull()
    seconds = F.coalesce(F.sum(F.when(good, F.col("seconds"))), F.lit(0.0))
    pages = F.coalesce(F.sum(F.when(good, F.col("pages"))), F.lit(0))
    return converted.agg(
        F.count_if(good).alias("converted"), F.count_if(~good & ~F.col("skipped")).alias("failed"), F.count_if(~good & F.col("skipped")).alias("skipped"),
        pages.alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.avg(F.length("text")).alias("avg_characters"),
        seconds.alias("seconds"), (seconds / F.nullif(F.count_if(good), F.lit(0))).alias("seconds_per_file"), (seconds / F.nullif(pages, F.lit(0))).alias("seconds_per_page"),
    )


def page_text(html: Column) -> Column:
    """Readable text of a web page: scripts, styles, comments and tags out, blocks on lines of their own, entities of markup read."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/h[1-6]|/div|/li|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    # The entities that markup itself needs.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "[ \t\r]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " ?\n ?", "\n"), "\n{2,}", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")
