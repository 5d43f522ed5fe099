"""Adapter dimensions for the driver tables (invented mappings that turn
TPC-H-like columns into rating-study inputs).  Shared by the Spark queries
and the oracle SQL so both sides use the same values."""

from __future__ import annotations

from ..operators.summaries import EMOTION_LEVELS, age_brackets

# Segment -> gender label; 'household' has no entry (unmatched -> null) and
# 'machinery' maps to the text label NA (null unless the label is kept).
GENDER_RECODE = [("automobile", "female"), ("building", "male"), ("furniture", "non-binary"), ("machinery", "NA")]

ETHNICITY_LABELS = ["White", "Black", "Asian", "Latine", "Mixed"]


def ethnicity_recode() -> list[tuple[str, str]]:
    """nation_i -> one of five labels; every nation with i % 7 == 3 is left
    out (a gap in the recode table)."""
    return [(f"nation_{i}", ETHNICITY_LABELS[i % 5]) for i in range(25) if i % 7 != 3]


# The ethnicity category levels of the reference, in order.
ETHNICITY_LEVELS = [
    "White",
    "Black",
    "Asian",
    "Indigenous",
    "Middle Eastern or North African (MENA)",
    "Latine",
    "Mixed",
    "Ambiguous label",
]

# Order-priority levels for the zero-count-level check; '0-ABSENT' never
# occurs and '5-LOW' is outside the set.
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "0-ABSENT"]

# Emotion categories of the categorisation task, in order.
EMOTION_CATEGORIES = ["anger", "disgust", "fear", "happiness", "sadness", "surprise"]

# The view codes of stimulus names in the source study.
VIEW_CODES = ["0", "l45", "l90", "r45", "r90"]

# Levels of the typed CSV query; PROMO and STANDARD lie outside them.
PART_TYPES = ["ECONOMY", "SMALL", "MEDIUM", "LARGE"]

VIEWS = ["front", "left45", "left90", "right45", "right90"]

EMOTION_CODES = [code for code, _ in EMOTION_LEVELS]
BRACKETS = age_brackets()


def sql_values(rows, names: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) v({names}))"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + s + "'" for s in items) + "]"
