"""Text functions as column expressions; Unicode normal form C and counts of letters, by operations on arrays of bytes, need Python."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS_PER_WORD = 3.5


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """3.5 tokens a word, rounded down."""
    return F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)).cast("int")


# Fixed values, in the order in which they are applied.
MARKS_TO_DROP = [
    "[\u0591-\u05c7]",  # vowel points and accents
    "[\u05f3\u05f4]",  # geresh, gershayim
    "\u00ad",  # soft hyphen
    "[\u200b-\u200d\ufeff]",  # zero width, byte order
    r"[\p{C}&&[^\n\t]]",
]
BULLETS = "•·∙●○◦▪▫■□▬▭▮▯◆◇◈◊"


def _finish(text: pa.Array) -> pa.Array:
    """Normal form C, ends trimmed."""
    return pa.array([None if x is None else (x if x.isascii() else unicodedata.normalize("NFC", x)).strip() for x in text.to_pylist()], pa.string())


def normalize_text(text: Column, drop_marks: bool = True, tidy_space: bool = True) -> Column:
    """Cleans text for a language model: marks and controls out, white space tidy, bullets as "- ", form C, ends trimmed. White space is that of Unicode, a line ends with a newline only."""
    out = text
    for pattern in MARKS_TO_DROP if drop_marks else MARKS_TO_DROP[2:]:
        out = F.regexp_replace(out, pattern, "")
    if tidy_space:
        for pattern, new in ((" {2,}", " "), (r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), ("\n{3,}", "\n\n"), (" +([.,;:!?])", "$1")):
            out = F.regexp_replace(out, pattern, new)
    out = F.regexp_replace(out, rf"(?dmU)^\s*[{BULLETS}]\s+", "- ")
    return F.arrow_udf(_finish, "string")(out)  # its input is computed once, below it


def _letter_counts(texts: pa.Array) -> pa.Array:
    """struct(hebrew, english) of the letters of each text, by the bytes of UTF-8; null for null."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    counts = np.zeros((2, len(texts)), np.int64)  # ten times as many are compared
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
        said = data[a:b]
        counts[1, i] = np.count_nonzero(((said | 32) - 97) < 26)
        if b > a and said.max() >= 0xD6:  # U+0590 to U+05FF: D6 90 to D7 BF
            counts[0, i] = np.count_nonzero(said == 0xD7) + np.count_nonzero((said[:-1] == 0xD6) & (said[1:] >= 0x90))
    kinds = pa.struct([("hebrew", pa.int64()), ("english", pa.int64())])
    return pa.StructArray.from_arrays([pa.array(c) for c in counts], fields=list(kinds), mask=texts.is_null())


def detect_languages(text: Column) -> Column:
    """struct(language, detected): Hebrew against Latin letters; one is listed if it has over a tenth of both."""
    counts = F.arrow_udf(_letter_counts, "struct<hebrew:bigint,english:bigint>")(text)  # one pass over the text for both
    hebrew, english = counts["hebrew"], counts["english"]
    total = hebrew + english
    listed = F.array_compact(
        F.array(F.when(hebrew * 10 > total, F.lit("hebrew")), F.when(english * 10 > total, F.lit("english")))
    )
    main = F.when(hebrew > english, "hebrew").when(english > 0, "english").otherwise("unknown")
    return F.struct(main.alias("language"), F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("unknown"))).alias("detected"))


def ocr_language(detected: Column, override: str | None = None) -> Column:
    if override:
        return F.lit(override)
    hebrew, english = F.array_contains(detected, "hebrew"), F.array_contains(detected, "english")
    return F.when(hebrew & english, "heb+eng").when(hebrew, "heb").otherwise("eng")


def safe_file_name(name: Column, extension: str = ".md") -> Column:
    """Base name without what is not a letter, digit, space, dash, underscore or dot; the extension replaced."""
    base = F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"(?U)[^\w \-.]", "")
    return F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(extension))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def location(source: Column, start: Column, end: Column) -> Column:
    return F.concat(source, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_location(text: Column) -> Column:
    """struct(source, line_start, line_end) of "file:10-20", split at the last colon; anything else is a file with lines 0 to 0."""
    pattern = r"(?s)^(.*):(\s*[+-]?\d+\s*)-([^:]*)$"
    a = F.regexp_extract(text, pattern, 2).try_cast("int")
    b = F.regexp_extract(text, pattern, 3).try_cast("int")
    good = a.isNotNull() & b.isNotNull()
    return F.struct(
        F.when(good, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("source"),
        F.when(good, a).otherwise(0).alias("line_start"),
        F.when(good, b).otherwise(0).alias("line_end"),
    )


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """Metadata header between dashes, one "key: value" a line."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def page_separator(number: Column) -> Column:
    return F.format_string("\n\n---\n**Page %d**\n---\n\n", number)
