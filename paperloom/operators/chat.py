"""Conversations and answers: memory, history, context, prompts and sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules as R

SYSTEM = "You answer questions about the user's documents. Rely on the passages below, name the documents that you use in square brackets, and say so when they don't hold the answer."
RISK = "Some of these documents are contracts or carry a risk tag: point out obligations, deadlines and penalties, and advise to have them reviewed."
NOTHING = "No matching documents were found."


class AnswerError(RuntimeError):
    """The model that writes answers can't be reached."""


def risky(document_type: Column, tags: Column) -> Column:
    """Whether a document is of a legal type or has a tag of high or medium risk."""
    return F.coalesce(F.lower(document_type).isin(*R.RISK_TYPES), F.lit(False)) | F.coalesce(F.exists(tags, lambda t: t.startswith(R.RISK_TAGS[0]) | t.startswith(R.RISK_TAGS[1])), F.lit(False))


def context(retrieved: DataFrame) -> DataFrame:
    """query_id, context: the retrieved documents (at most k a query) in order, each headed by its id and type."""
    part = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] ("), F.col("document_type"), F.lit(")\n"), F.col("page_content"))
    ordered = F.array_sort(F.collect_list(F.struct("pick", part.alias("part"))))
    return retrieved.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n---\n\n").alias("context"))


def sources(retrieved: DataFrame, scores: DataFrame) -> DataFrame:
    """What an answer cites: doc_name, page, similarity_score, document_type, tags and content_preview."""
    return retrieved.join(scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left").select(
        "query_id",
        "pick",
        F.col("doc_id").cast("string").alias("doc_name"),
        F.lit(1).alias("page"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("similarity_score"),
        "document_type",
        "tags",
        F.substring("page_content", 1, R.PREVIEW).alias("content_preview"),
    )


def history(turns: DataFrame) -> DataFrame:
    """All messages by session and turn."""
    return turns.select("conv_id", "turn", F.col("role"), F.col("text").alias("content"))


def memory(turns: DataFrame, exchanges: int = R.EXCHANGES) -> DataFrame:
    """conv_id, n_messages, memory: the last exchanges of each session (two messages each) as prompts show them.

    Only 2 * ``exchanges`` messages of a session are gathered; those before are
    left out by rank in the scan's own order.
    """
    said = turns.where(F.col("role").isin("user", "assistant"))
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = said.withColumn("back", back).where(F.col("back") <= 2 * exchanges)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(ordered, lambda p: p["line"]), "\n").alias("memory"))


def without_session(turns: DataFrame, session: int) -> DataFrame:
    """The turns without a session's."""
    return turns.where(F.col("conv_id") != session)


def prompt(question: Column, context_text: Column, memory_text: Column, any_risk: Column) -> Column:
    system = F.concat_ws("\n\n", F.lit(SYSTEM), F.when(any_risk, F.lit(RISK)))
    return F.struct(system.alias("system"), F.concat_ws("\n\n", F.nullif(memory_text, F.lit("")), F.concat(F.lit("Documents:\n"), F.coalesce(context_text, F.lit(NOTHING))), F.concat(F.lit("Question: "), question)).alias("user"))


def extractive(system: str, user: str) -> Iterator[str]:
    """A stand-in for a model: the first sentence of the first passage, word by word."""
    body = user.split("Documents:\n", 1)[-1].split("\n\nQuestion:", 1)[0]
    first = body.split("\n", 1)[-1].split(". ", 1)[0]
    yield from (w + " " for w in first.split())


def answer(prompted: dict[str, str], model: Callable[[str, str], Iterator[str]] = extractive) -> Iterator[dict]:
    """Frames of an answer: its tokens, then ``done`` with all of it, or ``error``."""
    said = []
    try:
        for token in model(prompted["system"], prompted["user"]):
            said.append(token)
            yield {"type": "token", "content": token}
    except OSError as x:
        yield {"type": "error", "content": str(AnswerError(x))}
        return
    yield {"type": "done", "content": "".join(said).strip()}
