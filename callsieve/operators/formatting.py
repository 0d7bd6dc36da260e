"""Training sets from triplets: chat rendering, length budget, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.functions.chatml import chat_prompt, completion, turn
from callsieve.functions.jsontext import is_strict_json

# Length limits of the trainers.
MAX_TOTAL_TOKENS = 2048
MAX_PROMPT_TOKENS = 768

#: Turn numbers that the first of the two aggregates of a conversation brings together.
TURNS_PER_PART = 1000


def renderable(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a text in every column, and the others, which cannot be rendered."""
    return complete_rows(df, *columns), incomplete_rows(df, *columns)


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a text in every column; the others belong to ``incomplete_rows``."""
    return df.dropna(subset=list(columns))


def incomplete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that cannot be rendered, because a text is missing."""
    missing = F.lit(False)
    for column in columns:
        missing = missing | F.col(column).isNull()
    return df.filter(missing)


def preference_pairs(df: DataFrame) -> DataFrame:
    """Render prompt, chosen and rejected as chat text; other columns are kept.

    Rows that lack one of the texts are not here but in the second table of ``renderable``.
    """
    return complete_rows(df, "prompt", "chosen", "rejected").withColumns(
        {"prompt": chat_prompt("prompt"), "chosen": completion("chosen"), "rejected": completion("rejected")}
    )


def supervised_texts(df: DataFrame) -> DataFrame:
    """Add ``text``: prompt and chosen reply in one string; rows that lack one are left to
    ``renderable``."""
    return complete_rows(df, "prompt", "chosen").withColumn(
        "text", F.concat(chat_prompt("prompt"), completion("chosen"))
    )


def conversation_texts(df: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Multi-turn chat text, one row for each conversation, turns in order.

    A conversation with a turn that lacks its role or text is not here but in
    ``incomplete_conversations``. Turns are first joined in parts of ``turns_per_part`` turn numbers, so that sorting and
    joining an endless conversation is spread over many groups; then its parts are joined.
    """
    turns = df.select(
        "conv_id",
        F.floor(F.col("turn") / turns_per_part).cast("long").alias("part"),
        "turn",
        turn(F.col("role"), F.col("text")).alias("segment"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "segment")))
    lacking = F.count_if(F.col("segment").isNull()).alias("n_lacking")
    grouped = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), lacking, ordered.alias("__turns"))
    joined = F.array_join(F.col("__turns.segment"), "\n").alias("text")
    parts = grouped.select("conv_id", "part", "n_turns", "n_lacking", joined)
    in_order = F.array_sort(F.collect_list(F.struct("part", "text")))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_lacking").alias("n_lacking"), in_order.alias("__parts")
    )
    whole = whole.filter("n_lacking = 0")
    return whole.select("conv_id", "n_turns", F.array_join(F.col("__parts.text"), "\n").alias("text"))


def incomplete_conversations(df: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_lacking`` of conversations with turns that lack role or text, which cannot be
    rendered as a whole."""
    lacking = F.col("role").isNull() | F.col("text").isNull()
    counted = df.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(lacking).alias("n_lacking"))
    return counted.filter("n_lacking > 0")


def word_count(text: str):
    """Whitespace-separated words: a stand-in for tokens where no tokenizer is at hand."""
    return F.regexp_count(F.col(text), F.lit(r"\S+"))


def truncate_words(text: str, most: int):
    """The text up to the end of its ``most``-th word; what is shorter stays as it is.

    Nothing is ever given back (possessive quantifiers), so that words are read in a loop, however many.
    """
    head = F.regexp_extract(F.col(text), rf"^(?:\s*+\S++){{0,{most}}}+", 0)
    return F.when(word_count(text) > most, head).otherwise(F.col(text))


def truncate_to_budget(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Cut each column of ``limits`` to its number of words."""
    return df.withColumns({column: truncate_words(column, most) for column, most in limits.items()})


def pair_budget(
    df: DataFrame, max_total: int = MAX_TOTAL_TOKENS, max_prompt: int = MAX_PROMPT_TOKENS, drop: bool = False
) -> DataFrame:
    """Length flags of preference pairs: the total is the prompt and the longer of both replies."""
    reply = F.greatest(word_count("chosen"), word_count("rejected"))
    counted = df.withColumn("n_tokens", word_count("prompt") + reply)
    return length_budget(counted, prompt="prompt", max_total=max_total, max_prompt=max_prompt, drop=drop)


def length_budget(
    df: DataFrame,
    text: str = "text",
    prompt: str | None = None,
    max_total: int = MAX_TOTAL_TOKENS,
    max_prompt: int = MAX_PROMPT_TOKENS,
    drop: bool = False,
) -> DataFrame:
    """Add ``n_tokens`` and flags for texts over the limits; optionally drop those rows.

    A table that already has ``n_tokens`` (from a tokenizer) keeps it.
    """
    if "n_tokens" not in df.columns:
        df = df.withColumn("n_tokens", word_count(text))
    df = df.withColumn("over_total", F.col("n_tokens") > max_total)
    df = df.withColumn("over_prompt", word_count(prompt) > max_prompt if prompt else F.lit(False))
    return df.filter("NOT over_total AND NOT over_prompt") if drop else df


def inspect_outputs(df: DataFrame, n: int, order_by: str = "example_id", response: str = "response") -> DataFrame:
    """The first ``n`` rows by key: cut prompt and expected call, whole response, JSON status."""
    return df.orderBy(order_by).limit(n).select(
        order_by,
        F.concat(F.substring("prompt", 1, 100), F.lit("...")).alias("prompt_head"),
        F.concat(F.substring("chosen", 1, 150), F.lit("...")).alias("expected_head"),
        F.col(response).alias("response"),
        is_strict_json(response).alias("is_json"),
    )
