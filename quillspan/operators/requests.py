"""Requests to a reader: templates filled with contexts and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The version of the templates; a changed text needs a new one.
VERSION = "q1"
#: What a request says with and without a context. The context is put in before the question, so that braces in a question stay as they are.
WITH_CONTEXT = "Passages of filings follow, each under its document and page.\n\n{CONTEXT}\n\nQuestion: {QUESTION}\nUse the passages. End with the lines \"Final answer:\" and \"Sources:\" (document, page)."
WITHOUT_CONTEXT = "Question: {QUESTION}\nAnswer from what you know. End with the line \"Final answer:\"."


def rendered(question: Column, context: Column) -> Column:
    """The text of a request; without a context (null) the closed template."""
    opened = F.replace(F.replace(F.lit(WITH_CONTEXT), F.lit("{CONTEXT}"), context), F.lit("{QUESTION}"), question)
    return F.when(context.isNotNull(), opened).otherwise(F.replace(F.lit(WITHOUT_CONTEXT), F.lit("{QUESTION}"), question))


def requests(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, kosul, version, text, n_words, pages) for every question: one request without context (K0), and one for each row of
    ``contexts`` (qid, kosul, context, n_words, pages array<struct<doc, page>>). A null question has no requests."""
    asked = questions.where("question IS NOT NULL").select("qid", "question")
    none = asked.select("qid", "question", F.lit("K0").alias("kosul"), F.lit(None).cast("string").alias("context"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<struct<doc:string,page:int>>").alias("pages"))
    every = none.unionByName(asked.join(contexts.select("qid", "kosul", "context", F.col("n_words").cast("bigint").alias("n_words"), "pages"), "qid"))
    return every.select("qid", "kosul", F.lit(VERSION).alias("version"), rendered(F.col("question"), F.col("context")).alias("text"), "n_words", "pages")


def refuse_locked(questions: DataFrame, locked: DataFrame, allowed: bool = False) -> DataFrame:
    """``questions`` as they are; raises if any of them (by qid) is locked and that was not ``allowed``."""
    if not allowed and not questions.join(locked, "qid", "left_semi").isEmpty():
        raise ValueError("a locked question is measured; allow it explicitly")
    return questions
