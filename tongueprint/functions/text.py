"""Text columns: whitespace, line breaks, tokens and character n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Unicode counts as whitespace, and those that end a line.
WHITESPACE_CHARS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
LINE_BREAK_CHARS = r"\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}"

WHITESPACE = f"[{WHITESPACE_CHARS}]+"
NOT_WHITESPACE = f"[^{WHITESPACE_CHARS}]"
LINE_BREAK = rf"\r\n|[{LINE_BREAK_CHARS}]"


def strip(col: Column) -> Column:
    """Drop whitespace of any kind at both ends (``trim`` drops spaces only)."""
    return strip_chars(col, WHITESPACE_CHARS)


def strip_chars(col: Column, chars: str) -> Column:
    """Drop every leading and trailing character of the regex class ``chars``."""
    return F.regexp_replace(col, rf"^[{chars}]+|[{chars}]+\z", "")


def rstrip_chars(col: Column, chars: str) -> Column:
    return F.regexp_replace(col, rf"[{chars}]+\z", "")


def has_text(col: Column) -> Column:
    """True where the column holds at least one character that is not whitespace."""
    return F.coalesce(F.rlike(col, F.lit(NOT_WHITESPACE)), F.lit(False))


def first_token(col: Column) -> Column:
    return F.element_at(F.split(strip(col), WHITESPACE), 1)


def one_line(col: Column) -> Column:
    """Text for models that read one line: newlines become spaces, ends are trimmed."""
    return strip(F.translate(col, "\n", " "))


def explode_lines(df: DataFrame, text_col: str, out_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line; ``line_no`` counts from 0 within the row."""
    return df.select(*keep, F.posexplode(F.split(F.col(text_col), LINE_BREAK)).alias("line_no", out_col))


def explode_tokens(df: DataFrame, text_col: str, keep: Sequence[str], outer: bool = False) -> DataFrame:
    """One row per lower-cased whitespace token, in column ``token``.

    With ``outer`` a row whose text has no token stays, with a null token.
    """
    tokens = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WHITESPACE)
    out = df.select(*keep, F.explode(tokens).alias("token"))
    if outer:
        return out.withColumn("token", F.nullif(F.col("token"), F.lit("")))
    return out.where(F.col("token") != "")


def explode_grams(
    df: DataFrame, lo: int, hi: int, keep: Sequence[str], outer: bool = False, first: str | None = None
) -> DataFrame:
    """One row per character n-gram (``lo <= n <= hi``) of the space-padded ``token``, in column ``gram``.

    Each start position is exploded first and its grams are cut from one short substring, which
    keeps all of it inside generated code; array lambdas over the same grams took 2-3x as long.
    A padded token shorter than ``lo`` counts once, whole. ``first`` names a flag column to add: true for
    one row of each token, its first n-gram (or its only row, if null).
    """
    if not 1 <= lo <= hi:
        raise ValueError(f"bad n-gram range ({lo}, {hi})")
    explode = F.explode_outer if outer else F.explode
    number = F.posexplode_outer if outer else F.posexplode
    start = ["_start"] if first else []
    padded = F.concat(F.lit(" "), F.col("token"), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_padded") - F.lit(lo - 1)))
    window = F.substring("_padded", F.col("_start"), F.lit(hi))

    def cuts(longest: int) -> Column:
        return F.array(*[F.substring("_cut", F.lit(1), F.lit(n)) for n in range(lo, longest + 1)])

    grams = F.when(F.col("_cut").isNull(), F.lit(None).cast("array<string>"))
    for longest in range(hi, lo, -1):
        grams = grams.when(F.length("_cut") >= longest, cuts(longest))
    grams = grams.otherwise(F.array(F.col("_cut")))
    windows = (
        df.select(*keep, padded.alias("_padded"))
        .select(*keep, "_padded", explode(starts).alias("_start"))
        .select(*keep, *start, window.alias("_cut"))
    )
    if first is None:
        return windows.select(*keep, explode(grams).alias("gram"))
    is_first = (F.coalesce("_start", F.lit(1)) == 1) & (F.coalesce("_place", F.lit(0)) == 0)
    return windows.select(*keep, *start, number(grams).alias("_place", "gram")).select(*keep, "gram", is_first.alias(first))


def gram_total(text_col: str, lo: int, hi: int) -> Column:
    """Number of n-grams of a text by token lengths alone, without building any gram."""
    tokens = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WHITESPACE)

    def per_token(token: Column) -> Column:
        padded = F.length(token) + F.lit(2)
        parts = [F.greatest(F.lit(0), padded - F.lit(n - 1)) for n in range(lo, hi + 1)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return F.when(token == "", F.lit(0)).otherwise(F.greatest(F.lit(1), total))

    return F.aggregate(tokens, F.lit(0), lambda acc, token: acc + per_token(token))
