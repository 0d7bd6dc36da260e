"""Model responses as a table, joined to the examples they answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.functions.chatml import chat_prompt


def inference_prompts(examples: DataFrame) -> DataFrame:
    """The prompt a model is asked with; the same text that training examples begin with."""
    return examples.withColumn("model_prompt", chat_prompt("prompt"))


def join_responses(responses: DataFrame, examples: DataFrame, key: str = "example_id") -> DataFrame:
    """Responses with the schema of their example.

    Most examples have a few responses, so no count of them is made first; where one has very
    many, the join is split as it runs.
    """
    return responses.join(examples.select(key, "schema_id"), key)


def missing_responses(
    responses: DataFrame, examples: DataFrame, models: list[str], key: str = "example_id"
) -> DataFrame:
    """``(example, model)`` pairs without a response, for the models that should have answered.

    Answered pairs are made distinct first, so frequent ones shrink before the shuffle.
    """
    asked = F.explode(F.lit(models).cast("array<string>")).alias("model")
    answered = responses.select(key, "model").distinct()
    return examples.select(key, asked).join(answered, [key, "model"], "left_anti")


def respond(
    examples: DataFrame, answer: Callable[[pd.Series], pd.Series], model: str, key: str = "example_id"
) -> DataFrame:
    """Response table from a user's own batch function: prompts in, responses out."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = answer(frame["model_prompt"])
            yield pd.DataFrame({key: frame[key], "model": model, "response": replies})

    prompts = inference_prompts(examples).select(key, "model_prompt")
    key_type = prompts.schema[key].dataType.simpleString()
    return prompts.mapInPandas(batches, f"{key} {key_type}, model string, response string")
