"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators import quantities
from quillspan.plans import answers, audits, evaluation, grades, retrieval
from quillspan.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "sorular", "kayit_no", "financebench_id", "question", "answer")
    return quantities.stated_quantities(questions, table(spark, d, "cevaplar", "kayit_no", "id", "yanit"))


MODULES = (retrieval, evaluation, answers, grades, audits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {"p3_found": p3_found}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.SQL
    return found
