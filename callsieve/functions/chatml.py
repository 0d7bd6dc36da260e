"""ChatML rendering as Columns. The same prompt builder serves training and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt text and markers must match byte for byte.
SYSTEM_PROMPT = (
    "You are a tool-calling assistant. When given a user request and tool specification, respond "
    "with ONLY a valid JSON object representing the tool call. Do not include any explanation, "
    "markdown formatting, or code blocks. Output raw JSON only."
)
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"


def turn(role: Column, text: Column) -> Column:
    """One closed turn; NULL if either part is NULL."""
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END))


def chat_prompt(user_text: Column | str) -> Column:
    """System turn, user turn and the opening of the assistant turn."""
    user = F.col(user_text) if isinstance(user_text, str) else user_text
    return F.concat(
        turn(F.lit("system"), F.lit(SYSTEM_PROMPT)),
        F.lit("\n"),
        turn(F.lit("user"), user),
        F.lit(f"\n{TURN_START}assistant\n"),
    )


def completion(text: Column | str) -> Column:
    """An assistant reply closed by the end-of-turn marker."""
    reply = F.col(text) if isinstance(text, str) else text
    return F.concat(reply, F.lit(TURN_END))
