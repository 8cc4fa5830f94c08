"""Text columns: keys, categories, panel fields, message headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from argusline.functions.fixed import PANEL, REVERSE_WORDS, SHIFT_WORDS, TOLERANCES


def clean_key(c: Column) -> Column:
    """Upper case, only A-Z and 0-9; null gives an empty key."""
    return F.coalesce(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def sanitize_category(c: Column) -> Column:
    """Letters, digits, space, ``_`` and ``-``; empty gives ``Unknown``."""
    kept = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("Unknown"))


def is_blank(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin("", "-")


def spaced(c: Column) -> Column:
    """Upper-case words of letters and digits, one space between."""
    return F.upper(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))


def alias_category(c: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """Category of the first alias, in order, that the spaced text contains.

    Null, blank and ``-`` give ``Unknown``; no alias gives null.
    """
    text, out = spaced(c), None
    for alias, category in aliases:
        out = F.when(text.contains(alias), category) if out is None else out.when(text.contains(alias), category)
    return F.when(is_blank(c), "Unknown").otherwise(out if out is not None else F.lit(None).cast("string"))


def tokens(c: Column) -> Column:
    """Words of letters and digits that have 3 or more and are not numbers."""
    words = F.split(spaced(c), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))


def unknown_trace(c: Column) -> Column:
    """The words that were tried when no category was found."""
    return F.concat_ws(", ", tokens(c))


def first_line_field(lines: Column, pattern: str) -> Column:
    """Capture of the first line that matches and captures something."""
    hits = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, pattern, 1))), lambda x: x != "")
    return F.try_element_at(hits, F.lit(1))


def parse_panel(c: Column) -> Column:
    """struct<board, parts, value>: per field the first line that has it."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    return F.struct(*[first_line_field(lines, p).alias(k) for k, p in PANEL.items()])


def rewrite_words(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Replaces, ignoring case, wordings that match a rule's pattern."""
    for pattern, name in rules:
        c = F.regexp_replace(c, "(?i)" + pattern, name)
    return c


def _has(c: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.upper(c).rlike("|".join(words)), F.lit(False))


def tolerance_rule(engine: str, value: Column, category: Column | None = None) -> Column:
    """Threshold of an engine (a key of ``TOLERANCES``) for a text and category.

    Only the live displacement rule looks at the category as well.
    """
    usual, on_shift = TOLERANCES[engine]
    told = _has(value, SHIFT_WORDS)
    if engine == "shift" and category is not None:
        told = told | _has(category, SHIFT_WORDS[:1])
    return F.when(told, F.lit(on_shift)).otherwise(F.lit(usual))


def reverse_flag(value: Column) -> Column:
    """Whether the text says that the part is reversed."""
    return _has(value, REVERSE_WORDS)


def route_message(header: Column) -> Column:
    """struct<kind, command, size>: command, frame size, blank or error."""
    h = F.trim(F.coalesce(header, F.lit("")))
    size = F.when(h.rlike("^[0-9]+$"), h.try_cast("long"))
    kind = F.when(h.startswith("CMD_"), "command").when(size.isNotNull(), "frame").when(h == "", "blank").otherwise("error")
    return F.struct(kind.alias("kind"), F.when(h.startswith("CMD_"), F.substring(h, 5, 64)).alias("command"), size.alias("size"))


def stamp(label: Column, ts: Column) -> Column:
    """Sample id: label and time to the millisecond."""
    return F.concat_ws("_", label, F.date_format(ts, "yyyyMMdd_HHmmss_SSS"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def percent(x: Column) -> Column:
    """A share as a whole percentage, cut off."""
    return F.floor(x * 100).cast("int")


def compat(new: Column, old: Column, default: float) -> Column:
    """A metric under its new or its old name."""
    return F.coalesce(new, old, F.lit(default))


def gauge(shift: Column, area: Column) -> list[Column]:
    """Display ratios of displacement (to 0.15) and area (to 0.50), 1 at most."""
    return [F.least(shift / 0.15, F.lit(1.0)).alias("shift_gauge"), F.least(area / 0.50, F.lit(1.0)).alias("area_gauge")]
