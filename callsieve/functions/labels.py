"""Failure categories and the keyword each one comes from.

The category is read off the violated keyword, never off message text: a message quotes
user data, and quoted data can contain any phrase.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category names and the keyword behind each.
CATEGORIES = (
    "json_error",
    "hallucinated_param",
    "type_mismatch",
    "enum_violation",
    "missing_required",
    "other_schema_error",
)
KEYWORD_CATEGORY = {
    "additionalProperties": "hallucinated_param",
    "type": "type_mismatch",
    "enum": "enum_violation",
    "required": "missing_required",
}
OTHER = "other_schema_error"

# Which of several violations is the primary one: the shallowest path, then this order,
# then path order. Keywords not listed come last.
KEYWORD_RANK = {"type": 0, "enum": 1, "const": 2, "required": 3, "additionalProperties": 4}
OTHER_RANK = 5


def category_of(keyword: Column) -> Column:
    """Category of a violated keyword; NULL stays NULL."""
    out = F.when(keyword.isNull(), F.lit(None).cast("string"))
    for name, category in KEYWORD_CATEGORY.items():
        out = out.when(keyword == name, F.lit(category))
    return out.otherwise(F.lit(OTHER))


def json_error_message(text: Column) -> Column:
    """Quotes the original text, also where an extracted part was checked."""
    return F.concat(F.lit("Invalid JSON Syntax (raw: "), F.substring(F.coalesce(text, F.lit("")), 1, 100), F.lit("...)"))


def schema_error_message(detail: Column) -> Column:
    return F.concat(F.lit("Schema Violation: "), detail)
