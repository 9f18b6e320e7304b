"""Column expressions that the operators share. Times are whole milliseconds, places whole pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """x rounded half to even, as a whole number."""
    return F.rint(x).cast("long")


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(x, hi))


def normalize_token(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and apostrophes; other letters vanish."""
    # most words are plain already, and replacing costs several times the look at it; Java takes about ten times as long
    # over [^a-z0-9'] as over the ranges that it is
    return F.when(text.rlike(r"^[a-z0-9']*\z"), text).otherwise(F.regexp_replace(F.lower(text), r"[\x00-&(-/:-`{-\x{10FFFF}]+", ""))


def term_key(text: Column) -> Column:
    """Lower case without blanks and punctuation at both ends."""
    return F.lower(F.btrim(F.btrim(text), F.lit(".,!?;:\"')([]")))


def to_frames(ms: Column, fps: int) -> Column:
    """Frame of a time, half to even. fps must be positive."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    return half_even(ms * fps / F.lit(1000.0))


def ends_sentence(text: Column) -> Column:
    return F.btrim(text).rlike(r"[.!?]+[\")\]]?$")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative times count as zero."""
    ms = F.greatest(ms, F.lit(0))
    part = lambda of, mod, width: F.lpad((F.floor(of) % mod).cast("string"), width, "0")
    hours = F.floor(ms / 3600000)
    return F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), part(ms / 60000, 60, 2), F.lit(":"), part(ms / 1000, 60, 2), F.lit(","), part(ms, 1000, 3))


def clip_text(text: Column, limit: int) -> Column:
    """Blanks joined; a longer text is cut, loses its last partial token and gets an ellipsis."""
    text = F.btrim(F.regexp_replace(text, r"[ \n\t\r]+", " "))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.regexp_replace(F.left(text, F.lit(limit)), r" [^ ]*$", "")), F.lit("…"))).otherwise(text)


def citation(url: Column) -> Column:
    """Authority of a URL in lower case, without one leading www."""
    return F.regexp_replace(F.lower(F.coalesce(F.parse_url(url, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")
