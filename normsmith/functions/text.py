"""String scalars.

All are built-in Column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of a study's own names, to be given for real exports: the pattern
# of the title prefix removed from task resource names, a title carrying that
# prefix, and the folder prefixes removed from trial names.
TITLE_PATTERN = "(?:Pilot )?Study Ratings: "
TITLE_EXAMPLE = "Pilot Study Ratings: "
TRIAL_FOLDERS = ("stimuli", "attention_checks")


def first_match_removed(col: Column, pattern: str) -> Column:
    """R ``sub(pattern, "", x)``: remove the leftmost match only
    (``regexp_replace`` would remove every match), wherever line ends are."""
    return F.regexp_replace(col, F.lit(f"^((?s:.*?)){pattern}"), F.lit("$1"))


def strip_prefix(col: Column, prefixes: tuple[str, ...] = TRIAL_FOLDERS) -> Column:
    """Drop a leading ``<prefix>/``."""
    alt = "|".join(prefixes)
    return F.regexp_replace(col, F.lit(f"^({alt})/"), F.lit(""))


def task_label(res_name: Column, pattern: str = TITLE_PATTERN) -> Column:
    """Task label from the resource name (first match of the title
    prefix removed, then trimmed)."""
    return F.trim(first_match_removed(res_name, pattern))


def split_parts(col: Column, delim: str, names: tuple[str, ...], require: bool = True) -> list[Column]:
    """``separate_wider_delim(too_many='drop')``: the first ``len(names)``
    pieces; too few pieces is an error when ``require``."""
    parts = F.split(col, F.lit(delim))
    out = []
    for i, name in enumerate(names):
        piece = F.element_at(parts, i + 1) if not require else F.when(
            F.size(parts) >= len(names), F.element_at(parts, i + 1)
        ).otherwise(F.raise_error(F.concat(F.lit(f"too few pieces in '{delim}' split: "), col)))
        out.append(piece.alias(name))
    return out


def name_parts(col: Column) -> Column:
    """Split a name on runs of non-alphanumeric characters."""
    return F.split(col, F.lit("[^A-Za-z0-9]+"))


def name_values(col: Column, types: dict[str, str]) -> list[Column]:
    """The parts of a name as columns of the given types (``convert =
    TRUE``); a part that does not parse as its type is null."""
    parts = name_parts(col)
    return [F.get(parts, F.lit(i)).try_cast(t).alias(name) for i, (name, t) in enumerate(types.items())]


def format_p(p: Column) -> Column:
    """P20: ``<.001`` or three decimals without the leading zero."""
    return F.when(p < 0.001, F.lit("<.001")).otherwise(
        F.regexp_replace(F.format_string("%.3f", p), F.lit("^0"), F.lit(""))
    )
