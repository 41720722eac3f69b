"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and the others as named users; the loss mask covers the assistant's own turns. Turns of
``system`` speakers head every perspective and are nobody's. A rendering is returned as its
segments, one row per turn, with their place in the rendered text: concatenated in order they are
the text, so that a conversation of any length is never one row or one task's list.

Positions are counted inside stretches of SPAN turn numbers, and the stretches' totals are added up.

Defined results: turns are ordered by turn number (null last), then speaker, then text. A null or blank
speaker is an unnamed user and no participant; null text is an empty turn. Rows with a null
conversation form one conversation. Repeated rows are turns of their own. A conversation without a
participant has no perspective and so no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = ("system", "developer")
SPAN = 1024


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """conv_id, perspective, position, role, name, segment, start, mask_start, mask_length.

    Starts are characters of the rendered text; a mask of length 0 is a turn to read, not to learn."""
    who = F.trim(F.col(speaker))
    d = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                     F.when(who != "", who).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = F.coalesce("speaker", F.lit("")).isin(*system)
    people = d.filter(F.col("speaker").isNotNull() & ~part).select(
        F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    d = d.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(2 ** 60)))
    r = d.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(part, "system").otherwise("user")
    r = r.withColumn("role", role).withColumn("name", F.when(role == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    r = r.withColumn("segment", F.concat(head, "text", F.lit(CLOSE)))
    whole = ["of", "perspective"]
    inside = Window.partitionBy(*whole, "span").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    before = Window.partitionBy(*whole).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = r.groupBy(*whole, "span").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("segment")).alias("chars")).select(
        F.col("of").alias("o"), F.col("perspective").alias("p"), F.col("span").alias("s"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    size = F.length("segment")
    r = (r.withColumn("at", F.row_number().over(inside) - 1)
         .withColumn("chars", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - size)
         .join(spans, F.col("of").eqNullSafe(F.col("o")) & (F.col("perspective") == F.col("p")) & (F.col("span") == F.col("s"))))
    start = F.col("chars") + F.col("chars_before")
    learned = F.when(F.col("role") == "assistant", F.length("text") + len(CLOSE) - 1).otherwise(F.lit(0))
    return r.select("conv_id", "perspective", (F.col("at") + F.col("rows_before")).cast("bigint").alias("position"),
                    "role", "name", "segment", start.cast("bigint").alias("start"),
                    (start + F.length(head)).cast("bigint").alias("mask_start"), learned.cast("bigint").alias("mask_length"))
