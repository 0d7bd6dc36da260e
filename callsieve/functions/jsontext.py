"""Predicates and extraction on JSON text, as Columns.

``try_parse_json`` alone is not a validity test: it stops after the first value, so
``{"a":1} x`` passes. Text is therefore read inside two wrappers, ``[text]`` and
``{"v":text}``. After the first value the array wrapper can only go on with ``]`` or ``,``
and a value, the object wrapper only with ``}`` or ``,`` and a key; no text satisfies both
except one value with whitespace around it.

Known limits: ``NaN`` and ``Infinity`` literals are not JSON here. Text beyond the parser's own
limits cannot be read either; ``beyond_parser`` tells it from text that is no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip and the regex class \s see it.
_SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{_SPACE}+|{_SPACE}+\z"
# Fixed value, as the lenient mode states it: the first Markdown fence holding an object; the
# language tag is optional.
_FENCE = rf"(?sU)```(?:json)?{_SPACE}*(\{{.*?\}}){_SPACE}*```"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def parse_wrapped(text: Column | str) -> Column:
    """VARIANT array holding the one JSON value of ``text``; NULL when it is not strict JSON."""
    t = _col(text)
    one_key = F.json_object_keys(F.concat(F.lit('{"v":'), t, F.lit("}")))
    return F.when(one_key.isNotNull(), F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))))


def parse_strict(text: Column | str) -> Column:
    """VARIANT of the single JSON value in ``text``; NULL when it is not strict JSON.

    JSON ``null`` gives a variant null, which is not SQL NULL.
    """
    return F.try_variant_get(parse_wrapped(text), "$[0]", "variant")


# What the parser of the engine reads at most.
PARSER_DEPTH, PARSER_CHARS, PARSER_DIGITS = 1000, 20_000_000, 1000


#: Up to so many, brackets are only counted.
FEW_BRACKETS = 6


def nesting_depth(text: Column | str) -> Column:
    """How deep brackets nest outside of strings; an upper bound for the depth of a JSON value.

    Escaped characters go first, so that a string then ends at its next quote.
    """
    t = _col(text)
    plain = F.when(F.instr(t, "\\") > 0, F.regexp_replace(t, r"(?s)\\.", "")).otherwise(t)
    brackets = F.regexp_replace(plain, r'"[^"]*"|[^\[\]{}"]+|"', "")
    # Counted by runs: what opens and then closes is one step.
    runs = F.split(brackets, r"(?<=[\]}])(?=[\[{])")

    def step(acc: Column, run: Column) -> Column:
        opened = F.length(F.translate(run, "]}", ""))
        deepest = F.greatest(acc["most"], acc["depth"] + opened)
        return F.struct((acc["depth"] + opened * 2 - F.length(run)).alias("depth"), deepest.alias("most"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))
    return F.aggregate(runs, start, step, lambda acc: acc["most"])


def depth_bound(text: Column | str) -> Column:
    """How deep a JSON value can nest: the brackets opened, in strings too, where they are few, else
    ``nesting_depth``; at most what the parser can nest."""
    t = _col(text)
    opened = F.length(t) - F.length(F.translate(t, "{[", ""))
    return F.least(F.when(opened <= FEW_BRACKETS, opened).otherwise(nesting_depth(t)), F.lit(PARSER_DEPTH))


def beyond_parser(text: Column | str) -> Column:
    """Whether text is nested too deep, or holds too long a string or number, to be parsed."""
    t = _col(text)
    digits = t.rlike(rf"[0-9]{{{PARSER_DIGITS}}}")
    return (F.length(t) > PARSER_CHARS) | digits | (nesting_depth(t) >= PARSER_DEPTH)


def is_strict_json(text: Column | str) -> Column:
    """True iff the whole string is one JSON value; false for NULL."""
    return parse_wrapped(text).isNotNull()


def strip(text: Column | str) -> Column:
    """Remove Unicode white space at both ends (``trim`` only knows the space)."""
    return F.regexp_replace(_col(text), _EDGES, "")


def bare_object(text: Column | str) -> Column:
    """The stripped text when it runs from ``{`` to ``}``, else NULL."""
    t = _col(text)
    return F.when(t.rlike(rf"(?U)\A{_SPACE}*\{{") & t.rlike(rf"(?U)\}}{_SPACE}*\z"), strip(t))


def fenced_object(text: Column | str) -> Column:
    """The object inside the first Markdown fence, else NULL."""
    return F.nullif(F.regexp_extract(_col(text), _FENCE, 1), F.lit(""))


def embedded_object(text: Column | str) -> Column:
    """From the first ``{`` to its matching ``}``, else NULL.

    Braces are counted wherever they stand, inside strings too. The text is cut at every
    ``}``; the match is the first cut where as many braces were opened as closed.
    """
    t = _col(text)
    cuts = F.split(t.substr(F.instr(t, "{"), F.length(t)), "[}]", -1)

    def step(acc: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = acc["depth"] + opened - 1
        longer = F.struct(
            depth.alias("depth"),
            (acc["chars"] + F.length(piece) + 1).alias("chars"),
            (acc["left"] - 1).alias("left"),
            (depth == 0).alias("done"),
        )
        # The last piece is not closed by a brace.
        return F.when(acc["done"] | (acc["left"] <= 1), acc).otherwise(longer)

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.size(cuts).alias("left"), F.lit(False).alias("done")
    )
    chars = F.aggregate(cuts, start, step, lambda acc: F.when(acc["done"], acc["chars"]))
    return F.when(F.instr(t, "{") > 0, t.substr(F.instr(t, "{"), chars))


def extract_object(text: Column | str) -> Column:
    """Bare object, else fenced object, else embedded object, else NULL."""
    return F.coalesce(bare_object(text), fenced_object(text), embedded_object(text))


def lenient_text(text: Column | str) -> Column:
    """Text to validate in lenient mode: the extracted object, or the text itself."""
    return F.coalesce(extract_object(text), _col(text))
