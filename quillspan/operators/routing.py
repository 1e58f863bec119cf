"""Questions routed to the documents of the companies and years that they name, and searches kept to these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators.ranking import ranked

#: Words of company names that count for nothing, and other names of companies (as runs of tokens).
FORMS = ["corporation", "inc", "company", "co", "corp"]
ALIASES = {"jnj": "johnson johnson", "j j": "johnson johnson", "amex": "american express"}
#: Fixed value: the least length of a name that is also looked for in one word.
LEAST_JOINED = 6


def company_key(company: Column) -> Column:
    """Tokens of the name without its legal form; null if nothing is left."""
    return F.nullif(F.array_join(F.filter(T.tokens(company), lambda t: ~t.isin(*FORMS)), " "), F.lit(""))


def spellings(catalog: DataFrame) -> DataFrame:
    """(company, run): the runs of tokens that name each company of the catalog: its key, the key without the s that ends a last
    token of more than three letters, and its aliases."""
    names = catalog.select(company_key(F.col("company")).alias("company")).where("company IS NOT NULL").distinct()
    alias = F.create_map(*[F.lit(x) for pair in [(c, [a for a, named in ALIASES.items() if named == c]) for c in dict.fromkeys(ALIASES.values())] for x in pair])
    last = F.element_at(F.split("company", " "), -1)
    single = F.when((F.length(last) > 3) & last.endswith("s"), F.regexp_replace("company", "s$", ""))
    runs = F.array_compact(F.concat(F.array(F.col("company"), single), F.coalesce(alias[F.col("company")], F.array().cast("array<string>"))))
    return names.select("company", F.explode(F.array_distinct(runs)).alias("run"))


def mentions(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, company): companies that a question names, by a run of its tokens or by the joined letters of a name of at least
    LEAST_JOINED inside its own joined letters. Names may be of any length.

    Questions and names meet by equi-joins on a part of the name (its token that fewest names have; its first letters) and
    the whole name is looked for only in the questions met, so nothing is compared pairwise.
    """
    asked = questions.select("qid", T.tokens(F.col("question")).alias("w")).where(F.size("w") > 0)
    runs = spellings(catalog).withColumn("token", F.explode(F.array_distinct(F.split("run", " "))))
    held = runs.groupBy("token").agg(F.count(F.lit(1)).alias("names"))
    anchors = runs.join(held, "token").groupBy("company", "run").agg(F.min(F.struct("names", "token"))["token"].alias("token"))
    by_token = asked.select("qid", F.array_join("w", " ").alias("said"), F.explode(F.array_distinct("w")).alias("token")).join(anchors, "token")
    inside = F.concat(F.lit(" "), "said", F.lit(" ")).contains(F.concat(F.lit(" "), "run", F.lit(" ")))
    joined = F.replace("company", F.lit(" "), F.lit(""))
    names = spellings(catalog).select("company", joined.alias("joined")).where(F.length("joined") >= LEAST_JOINED).distinct().withColumn("head", F.substring("joined", 1, LEAST_JOINED))
    letters = asked.select("qid", F.array_join("w", "").alias("said")).where(F.length("said") >= LEAST_JOINED)
    heads = F.transform(F.sequence(F.lit(1), F.length("said") - LEAST_JOINED + 1), lambda i: F.substring(F.col("said"), i, F.lit(LEAST_JOINED)))
    by_letters = letters.select("qid", "said", F.explode(F.array_distinct(heads)).alias("head")).join(names, "head").where(F.col("said").contains(F.col("joined")))
    return by_token.where(inside).select("qid", "company").unionByName(by_letters.select("qid", "company")).distinct()


def route(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, doc_name, rule): documents of a named company whose year is a named one or the next (``year``); where no
    year is named or none fits, all of its documents (``company``). Questions without a company have no rows."""
    found = company_documents(questions, catalog)
    years = questions.select("qid", F.explode(T.fiscal_years(F.col("question"))).alias("year"))
    windows = years.select("qid", F.explode(F.array(F.col("year"), F.col("year") + 1)).alias("period")).distinct()
    fitting = found.join(windows, ["qid", "period"]).select("qid", "doc_name").distinct()
    rest = found.join(fitting.select("qid").distinct(), "qid", "left_anti").select("qid", "doc_name").distinct()
    return fitting.withColumn("rule", F.lit("year")).unionByName(rest.withColumn("rule", F.lit("company")))


def company_documents(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, doc_name, period): all documents of the companies that a question names."""
    docs = catalog.select("doc_name", company_key(F.col("company")).alias("company"), F.col("doc_period").alias("period")).where("company IS NOT NULL").distinct()
    return mentions(questions, catalog).join(docs, "company").select("qid", "doc_name", "period").distinct()


def routed_ranking(scored: DataFrame, routed: DataFrame, k: int = 100) -> DataFrame:
    """(qid, chunk_id, score, rank) of ``scored`` (qid, chunk_id, doc, score): the best k chunks of the documents that a question
    was routed to, filtered before the cut; the best k of all where it was routed nowhere."""
    pairs = routed.select("qid", F.col("doc_name").alias("doc")).distinct()
    inside = scored.join(pairs, ["qid", "doc"], "left_semi")
    rest = scored.join(pairs.select("qid").distinct(), "qid", "left_anti")
    return ranked(inside.unionByName(rest).select("qid", "chunk_id", "score"), ["qid"], [F.desc("score"), F.asc("chunk_id")], k)
