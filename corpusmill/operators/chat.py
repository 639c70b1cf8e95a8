"""Conversations as records: assembly, validity, mapping, digests, wire format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import collapse_whitespace, is_blank, normalized_all

#: Names that sources give to the three roles.
ROLES = {"user": ("user", "human", "prompter"), "assistant": ("assistant", "gpt", "model", "bot"), "system": ("system",)}


def canonical_role(role: Column) -> Column:
    """One of the three roles; null for a name that isn't known."""
    out = F.lit(None).cast("string")
    for name, aliases in ROLES.items():
        out = F.when(role.isin(*aliases), name).otherwise(out)
    return out


def assemble(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): a conversation's turns in order, as array<struct<role, content>>.

    Null texts become empty contents; null turns come first.
    """
    row = F.struct(F.col("turn"), canonical_role(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return listed.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))


def speakers(messages: Column) -> Column:
    """The messages after a first system message."""
    system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    return F.when(system, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def is_valid(messages: Column) -> Column:
    """Known roles, no blank content, at most a first system message, then user and assistant in turns, ending with the assistant."""
    turns = speakers(messages)
    expected = F.transform(turns, lambda m, i: F.coalesce(m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False)))
    whole = ~F.exists(messages, lambda m: is_blank(m["content"]))
    return whole & (F.size(turns) >= 2) & (F.size(turns) % 2 == 0) & F.forall(expected, lambda ok: ok)


def _contents(messages: Column) -> Column:
    return normalized_all(F.transform(messages, lambda m: m["content"]))


def identity(messages: Column) -> Column:
    """SHA-256 of the compact JSON of the normalised messages, keys in order."""
    rows = F.transform(_contents(messages), lambda text, i: F.struct(text.alias("content"), F.get(messages, i)["role"].alias("role")))
    return F.sha2(F.to_json(F.struct(rows.alias("messages"))), 256)


def overlap_hashes(messages: Column) -> Column:
    """SHA-256 of every message but system ones, normalised, and of all of them joined by blanks."""
    spoken = _contents(F.filter(messages, lambda m: m["role"] != "system"))
    joined = collapse_whitespace(F.array_join(spoken, " "))  # composed parts stay so across a blank
    return F.array_distinct(F.transform(F.array_append(spoken, joined), lambda t: F.sha2(t, 256)))


def instruction(prompt: Column, response: Column, context: Column | None = None, system: str | None = None) -> Column:
    """Messages of an instruction row: a constant system text, the prompt with its context under it, the response."""
    asked = prompt if context is None else F.when(is_blank(context), prompt).otherwise(F.concat_ws("\n\n", prompt, context))
    rows = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system is not None else []
    rows += [F.struct(F.lit("user").alias("role"), asked.alias("content")), F.struct(F.lit("assistant").alias("role"), response.alias("content"))]
    return F.array(*rows)


def wire(messages: Column, encode, role_ids: dict[str, int], end_id: int) -> tuple[Column, Column]:
    """(ids, mask): each message as its role's id, its content's ids, and the end of turn.

    encode: a column function from a content to array<int>. mask: of each id
    after the first, true if it is to be learned: an assistant's contents and
    their ends.
    """

    def one(m: Column) -> Column:
        role = F.lit(None).cast("int")
        for name, i in role_ids.items():
            role = F.when(m["role"] == name, F.lit(i)).otherwise(role)
        return F.concat(F.array(role), encode(m["content"]), F.array(F.lit(end_id)))

    def learned(m: Column) -> Column:
        return F.concat(F.array(F.lit(False)), F.array_repeat(m["role"] == "assistant", F.size(encode(m["content"])) + 1))

    ids, mask = F.flatten(F.transform(messages, one)), F.flatten(F.transform(messages, learned))
    return ids, F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0)))
