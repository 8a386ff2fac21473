"""Prompt tables for chat models, and parsing of their stored responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tongueprint.functions.text import rstrip_chars, strip, strip_chars
from tongueprint.sources.codes import CodeTable
from tongueprint.sources.corpus import TEXT

# The prompt that earlier results were made with.
SYSTEM_PROMPT = (
    "You are an expert language identification system. Given a piece of text (short or long), "
    "identify its language and respond with ONLY the ISO 639-3 code (three lowercase "
    'letters, e.g. "eng", "kab", "arb"). No explanations, no extra words.'
)
USER_HEAD = "Text:\n"
USER_TAIL = "\n\nISO 639-3 code:"


def prompt_table(df: DataFrame, examples: Sequence[tuple[str, str]] = (), text_col: str = TEXT) -> DataFrame:
    """Add ``messages``: the system turn, demonstration pairs, then the text to classify."""
    turns = [_turn("system", F.lit(SYSTEM_PROMPT))]
    for text, code in examples:
        turns += [_turn("user", _question(F.lit(text))), _turn("assistant", F.lit(code))]
    return df.withColumn("messages", F.array(*turns, _turn("user", _question(F.col(text_col)))))


def parse_responses(df: DataFrame, codes: CodeTable, raw_col: str = "raw_output", out_col: str = "pred") -> DataFrame:
    """Language code of each stored response: the cleaned whole, else its first word, else ``und``."""
    raw = strip(F.coalesce(F.col(raw_col), F.lit("")))
    bare = strip(strip_chars(strip_chars(raw, "`"), "\"'"))
    cleaned = df.withColumn("_response", rstrip_chars(bare, ".,;:!?"))
    return codes.normalize_first_known(cleaned, "_response", out_col).drop("_response")


def run_label(model: str, shot: int) -> str:
    return f"{model}-{shot}shot" if shot else model


def run_label_column(model: Column, shot: Column) -> Column:
    return F.when(shot > 0, F.concat(model, F.lit("-"), shot.cast("string"), F.lit("shot"))).otherwise(model)


def run_kind_column(model: Column, chat_models: Sequence[str]) -> Column:
    """``LLM`` for chat models (also under a shot label), else ``standard``."""
    base = F.regexp_replace(model, r"-\d+shot\z", "")
    return F.when(base.isin(list(chat_models)), F.lit("LLM")).otherwise(F.lit("standard"))


def _question(text: Column) -> Column:
    return F.concat(F.lit(USER_HEAD), text, F.lit(USER_TAIL))


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))
