"""Train, validation and test parts that keep related records together.

Records that share an id or a filing are linked through further records, so groups are connected components. Each
level cuts the edges into parts of bounded size, builds a local forest in every part by union-find and merges the
forests: every node takes the smallest root that any part gave it, and the edges between the new nodes that are left
go to the next level, which has fewer parts. Node names are md5 sums, hence in random order, and each level removes
at least a constant share of the nodes; there is no level in which one task holds all edges of a large graph.

Groups then go to the parts largest first, each to the part furthest below its target. Groups of one size are alike,
so the greedy rule is worked out on the histogram of sizes (at most about the square root of twice the number of
records) and each group finds its part by its number among those of its size.

Defined results: null or letterless names link nothing; a record without any name is a group of its own with a null
``grup``; repeated records are records; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.session import written

#: Edges that one task may hold, and parts that even the smallest level has.
EDGES_PER_PART, LEAST_PARTS = 250_000, 3


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one part: every node that is not a root, with its root, the smallest of its tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            ra, rb = find(a), find(b)
            if ra < rb:
                parent[rb] = ra
            elif rb < ra:
                parent[ra] = rb
    nodes = [x for x in parent if find(x) != x]
    yield pd.DataFrame({"node": nodes, "root": [parent[x] for x in nodes]}, dtype="object")


def spread(edges: DataFrame, parts: int) -> DataFrame:
    """Edges in parts by a hash of both names, so that the edges of a hot node lie in all of them."""
    return edges.repartition(parts, "a", "b")


def components(edges: DataFrame, edges_per_part: int = EDGES_PER_PART) -> DataFrame:
    """(node, component) of every node of ``edges`` (a string, b string) that is not itself the name of its component.

    The names should be hashes, as those of ``question_groups`` are: any names give right components, but the number
    of levels is only logarithmic where the names' order has nothing to do with the links.
    """
    levels: list[DataFrame] = []
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while count := now.count():
        parts = max(LEAST_PARTS, -(-count // edges_per_part))
        forest = written(spread(now, parts).mapInPandas(local_forest, "node string, root string"), "forest")
        up = forest.groupBy("node").agg(F.min("root").alias("up"))
        levels.append(written(up, "parents"))
        up = levels[-1]
        # A hot root shrinks to one row for each parent before it is looked up.
        links = forest.join(up, "node").select(F.col("up").alias("x"), "root").distinct()
        links = links.join(up.select(F.col("node").alias("root"), F.col("up").alias("y")), "root", "left").select("x", F.coalesce("y", "root").alias("y"))
        links = links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now = written(links, "edges")
    if not levels:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    found = levels[-1].select("node", F.col("up").alias("component"))
    for up in reversed(levels[:-1]):
        later = found.select(F.col("node").alias("up"), F.col("component").alias("c"))
        # A name that was a root up to here stands for itself; any other name has moved on to its parent.
        roots = found.join(up, "node", "left_anti")
        found = up.join(later, "up", "left").select("node", F.coalesce("c", "up").alias("component")).unionByName(roots)
        found = written(found, "components")
    return found


def bare(column: str | F.Column) -> F.Column:
    """Letters and digits in lower case; null where there are none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]", ""), F.lit(""))


def question_groups(records: DataFrame) -> DataFrame:
    """(kayit_no, grup) of every record of the question table; ``grup`` is the smallest id of the group."""
    document = bare(F.regexp_replace(F.lower("doc_name"), r"\.pdf\s*$", ""))
    named = records.select("kayit_no", bare("financebench_id").alias("id"), document.alias("doc"))
    named = named.select("kayit_no", "id", F.md5(F.concat(F.lit("id:"), "id")).alias("a"), F.md5(F.concat(F.lit("doc:"), "doc")).alias("b"))
    names = named.select("id", "a", "b").distinct()
    component = components(names.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "key")
    keys = names.select(F.coalesce("a", "b").alias("key"), "id").distinct()
    keys = written(keys.join(component, "key", "left").select("key", "id", F.coalesce("component", "key").alias("component")), "keys")
    digits = F.regexp_extract("id", r"^financebenchid(\d{8})$", 1)
    form = F.when(digits != "", F.concat(F.lit("financebench_id_"), digits)).otherwise(F.col("id"))
    first = keys.groupBy("component").agg(F.min(form).alias("grup"))
    names_of = keys.join(first, "component").where("key IS NOT NULL").groupBy("key").agg(F.min("grup").alias("grup"))
    return named.select("kayit_no", F.coalesce("a", "b").alias("key")).join(names_of, "key", "left").select("kayit_no", "grup")


def greedy_quotas(sizes: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """``sizes`` are (size, number of groups), largest first. Rows (size, part, first, end): which of the groups of a
    size, by number, go to which part when each in turn goes to the part furthest below its target."""
    total = sum(s * c for s, c in sizes)
    names = list(shares)
    missing = [shares[x] * total / sum(shares.values()) for x in names]
    rows = []
    for size, count in sizes:
        taken = [0] * len(names)
        low, high = min(missing) - size * (count + 1), max(missing)
        for _ in range(80):  # the level to which whole groups fill all parts
            level = (low + high) / 2
            if sum(max(0, int((m - level) // size)) for m in missing) > count:
                low = level
            else:
                high = level
        taken = [max(0, int((m - high) // size)) for m in missing]
        for _ in range(count - sum(taken)):
            k = max(range(len(names)), key=lambda i: (missing[i] - taken[i] * size, -i))
            taken[k] += 1
        at = 0
        for k, name in enumerate(names):
            if taken[k]:
                rows.append((size, name, at, at + taken[k]))
            at += taken[k]
            missing[k] -= taken[k] * size
    return rows


def assign_parts(members: DataFrame, group: str, shares: dict[str, float], groups_per_bucket: int = 50_000) -> DataFrame:
    """``group`` and ``bolum`` of every group of ``members``; null groups are left out."""
    spark: SparkSession = members.sparkSession
    sized = written(members.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size")), "groups")
    sizes = [(r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()]
    quotas = spark.createDataFrame(greedy_quotas(sizes, shares), "size long, bolum string, first long, end long")
    buckets = max(1, -(-sum(n for _, n in sizes) // groups_per_bucket))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(group), F.lit(buckets)))
    before = sized.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(group)) - 1
    numbered = sized.withColumn("number", number).join(before, ["size", "bucket"]).withColumn("number", F.col("number") + F.col("before"))
    return numbered.join(quotas, (numbered["size"] == quotas["size"]) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))).select(group, "bolum")


def question_parts(records: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(kayit_no, grup, bolum). A record without a group (no name at all) is in the first part."""
    groups = written(question_groups(records), "question-groups")
    parts = assign_parts(groups, "grup", shares)
    return groups.join(parts, "grup", "left").select("kayit_no", "grup", F.coalesce("bolum", F.lit(next(iter(shares)))).alias("bolum"))
