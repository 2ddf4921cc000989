"""Names, plate patterns, tokens and times as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of vehicles and violations, density levels.
VEHICLE_CODES = {"undecided": "", "bike": "XMA", "car": "OTO"}
VIOLATION_CODES = {"lane": "SLD", "red_light": "VDD"}
DENSITY_LEVELS = ((25, "Free"), (65, "Uncrowded"), (80, "Crowded"))


def code(col: Column, codes: dict[str, str]) -> Column:
    return reduce(lambda out, kv: out.when(col == kv[0], kv[1]), list(codes.items())[1:], F.when(col == next(iter(codes)), next(iter(codes.values()))))


def tokens(col: Column, delimiter: str) -> Column:
    """Parts between delimiters without the empty ones; a text without delimiter is one part."""
    return F.filter(F.split(col, f"[{delimiter}]"), lambda t: t != "")


#: Pattern letters: a letter, a digit, any character whose place is skipped in the result.
PATTERN_LETTERS = {"@": "[A-Z]", "#": "[0-9]", "?": "."}


def compile_pattern(pattern: str) -> tuple[str, list[int]]:
    """Regular expression of a plate pattern and the places (from 0) to skip; sets and literals stay."""
    out, skips, place, at = [], [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at) if c == "[" else at
        piece = pattern[at : end + 1]
        if c == "?":
            skips.append(place)
        out.append(PATTERN_LETTERS.get(c) or (piece if c == "[" else "\\" + c if not c.isalnum() else c))
        place, at = place + 1, end + 1
    return "".join(out), skips


def drop_places(col: Column, places: list[int]) -> Column:
    """The text without the characters at these places."""
    if not places:
        return col
    return F.array_join(F.filter(F.split(col, ""), lambda c, i: ~i.isin(*places)), "")


def density_level(percent: Column) -> Column:
    out = F.when(percent < DENSITY_LEVELS[0][0], DENSITY_LEVELS[0][1])
    for top, name in DENSITY_LEVELS[1:]:
        out = out.when(percent < top, name)
    return out.otherwise("Too crowded")


def learning_rate(percent: Column, low: float, high: float, most: float) -> Column:
    """Falls with the place in the density band along a normal curve."""
    y = (percent - low) / (high - low)
    return most * F.exp(-y * y / 2) / 2.5066282746310002


def hhmmss(seconds: Column) -> Column:
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(part(F.floor(seconds / 3600)), part(F.floor(seconds / 60) % 60), part(seconds % 60))


def box_text(x, y, w, h) -> Column:
    return F.concat_ws(",", x, y, w, h)


def box_of_text(col: Column) -> Column:
    p = F.split(col, ",")
    return F.struct(*[p[i].cast("long").alias(n) for i, n in enumerate("xywh")])


def map_path(col: Column, src: str, dst: str) -> Column:
    """A local prefix rewritten to a network one, where one is set."""
    return F.replace(col, F.lit(src), F.lit(dst)) if dst else col
