"""Preference formatting: one prompt from the longest common turn prefix of a chosen and a rejected conversation,
and the two masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import running

TURN = "array<struct<turn:bigint,role:string,text:string>>"
#: Role tags and the end of a turn.
OPEN, ROLE_END, CLOSE = "<|", "|>\n", "<|end|>\n"


def _escaped(c: Column) -> Column:
    """The text with a backslash more in every <| , so that it opens no tag; what it was can be told from it."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(ROLE_END), t["text"], F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _trained(turns: Column, roles: list[str]) -> Column:
    """start:end of what is trained on in the rendered turns: text and end mark of the turns of these roles."""

    def step(at: Column, t: Column) -> tuple[Column, Column]:
        begin = at + F.length(t["role"]) + len(OPEN) + len(ROLE_END)
        end = (begin + F.length(t["text"]) + len(CLOSE)).cast("int")
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return end, F.when(t["role"].isin(*roles), span).otherwise(F.array().cast("array<string>"))

    return F.array_join(running(turns, "string", F.lit(0), step), ",")


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", chosen_col: str = "is_chosen", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask of each pair.

    turns has a row for each turn of each side. A side's turns come by (turn, role, text); null turn numbers come first,
    null roles and texts stand as empty strings. The prompt is the longest common prefix of (role, text); the masks
    list start:end (code points) of what a completion trains on. A <| in roles and texts is escaped. A side without turns gives an empty completion, equal
    sides two empty ones; repeated rows are repeated turns; a null pair is a pair of its own; an empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    text = lambda c: _escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = turns.select(F.col(pair_col).alias("pair_id"), F.coalesce(F.col(chosen_col), F.lit(False)).alias("c"), F.struct(F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    sides = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("c") == side, F.col("t")))).cast(TURN).alias(name) for side, name in ((True, "a"), (False, "b"))])
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    sides = sides.withColumn("n", F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)).cast("int") - 1, F.size(same)))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    cut = sides.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("head"), rest("a").alias("a"), rest("b").alias("b"))
    roles = list(trained_roles)
    return cut.select("pair_id", F.col("n").alias("prompt_turns"), _rendered(F.col("head")).alias("prompt"), _rendered(F.col("a")).alias("chosen"), _rendered(F.col("b")).alias("rejected"), _trained(F.col("a"), roles).alias("chosen_mask"), _trained(F.col("b"), roles).alias("rejected_mask"))
