"""Chat formatting: the same dialogue from the view of each of its speakers.

For every speaker of a conversation the whole dialogue is rendered with that
speaker as the assistant and all others as named users; the train spans cover
just what that speaker said, with its end mark. DataFrame functions only.

A conversation is rendered in parts of `part_turns` turn numbers, however long it
is; parts join in order to the whole dialogue. Turns of one number, or without,
are in one part. Defined cases: a null role speaks as "unknown", a null text
is empty, a null turn counts as -1 and comes first, rows that repeat exactly
count once, equal turns are ordered by role and text, a null conv_id is a
conversation of its own. "<|" inside a text is written "< |", so no text can
open a header; in a role %, |, <, > and line ends are written as % and their
hexadecimal code, so no two roles become one. Context roles (system) are rendered for all and are never a
speaker; a conversation of context roles only gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


#: Characters that would break a header, and what stands for them; % comes first, as it opens the others.
ESCAPES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"))


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit("unknown"))
    for plain, code in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def _header(role: Column, speaker: Column, context: tuple[str, ...]) -> Column:
    return (
        F.when(role == speaker, F.lit("<|assistant|>\n"))
        .when(role.isin(*context), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))
    )


def rotate_perspectives(turns: DataFrame, part_turns: int = 256, context_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, speaker, part, n_turns, n_trained, rendered, train_spans (array of start, end; in characters of `rendered`)."""
    clean = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        _role(F.col("role")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    parts = clean.groupBy("conv_id", F.floor(F.col("turn") / part_turns).alias("part")).agg(
        F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("said")
    )
    speakers = clean.where(~F.col("role").isin(*context_roles)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    pieces = F.transform(
        "said",
        lambda m: F.struct(
            (m["role"] == F.col("speaker")).alias("own"),
            _header(m["role"], F.col("speaker"), context_roles).alias("head"),
            F.concat(m["text"], F.lit(END)).alias("body"),
        ),
    )
    views = views.withColumn("pieces", pieces)
    ends = F.aggregate(
        "pieces",
        F.array(F.lit(0)),
        lambda done, m: F.concat(done, F.array(F.element_at(done, -1) + F.length(m["head"]) + F.length(m["body"]) + 1)),
    )
    views = views.withColumn("ends", ends)
    spans = F.filter(
        F.transform(
            F.arrays_zip("pieces", F.slice("ends", 1, F.size("pieces")).alias("at")),
            lambda x: F.when(
                x["pieces"]["own"],
                F.struct(
                    (x["at"] + F.length(x["pieces"]["head"])).alias("start"),
                    (x["at"] + F.length(x["pieces"]["head"]) + F.length(x["pieces"]["body"])).alias("end"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return views.select(
        "conv_id",
        "speaker",
        "part",
        F.size("pieces").alias("n_turns"),
        F.size(F.filter("pieces", lambda m: m["own"])).alias("n_trained"),
        F.array_join(F.transform("pieces", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "").alias("rendered"),
        spans.alias("train_spans"),
    )
