"""O-86, O-87: chat messages as text. ``messages`` is an array of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_openai(messages: Column) -> Column:
    """Every message has a role and a content."""
    return messages.isNotNull() & F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())


def with_system(messages: Column) -> Column:
    """An empty system message stands first where there is none."""
    blank = F.array(F.struct(F.lit("system").alias("role"), F.lit("").alias("content")))
    return F.when(F.get(messages, F.lit(0))["role"] == "system", messages).otherwise(F.concat(blank, messages))


def render(messages: Column, prompt: bool = False) -> Column:
    """``<|role|>``, content and end mark of each message; a prompt ends with the assistant's mark."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("</s>\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n")) if prompt else body


def preference(chosen: Column, rejected: Column) -> tuple[Column, Column, Column]:
    """(prompt, chosen, rejected) texts: the prompt is all of chosen but its last message."""
    n = F.size(chosen)
    return render(with_system(F.slice(chosen, 1, F.greatest(n - 1, F.lit(0))))), render(F.slice(chosen, n, 1)), render(F.slice(rejected, F.size(rejected), 1))
