"""All pairs of equal or similar keys, as pairs of key classes that are taken apart last: keys are compared once for each two classes, however many rows have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a class that lie in one row. A pair of rows makes at most BLOCK * BLOCK pairs, which stream.
BLOCK = 512


def classes(rows: DataFrame, id_: str, *key: str) -> DataFrame:
    """(key..., k, ids): the ids of the rows of each key in blocks of at most BLOCK, k the number of a block. Null ids are left out."""
    grouped = rows.where(F.col(id_).isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_list(id_)).alias("ids"))
    cut = F.expr(f"transform(sequence(0, CAST((size(ids) - 1) DIV {BLOCK} AS INT)), i -> slice(ids, i * {BLOCK} + 1, {BLOCK}))")
    return grouped.select(*key, F.posexplode(cut).alias("k", "ids"))


def alike(blocks: DataFrame, within: list[str], by: str, test: str) -> DataFrame:
    """(ia, ib, same): pairs of blocks that agree in `within` and for whose rows a and b the test holds, each pair once and each block with itself; `by` is the rest of their key."""
    on = " AND ".join([*(f"a.{c} = b.{c}" for c in within), f"(a.{by} < b.{by} OR a.{by} = b.{by} AND a.k <= b.k)", f"({test})"])
    return blocks.alias("a").join(blocks.alias("b"), F.expr(on)).selectExpr("a.ids AS ia", "b.ids AS ib", f"a.{by} = b.{by} AND a.k = b.k AS same")


def expand(paired: DataFrame) -> DataFrame:
    """(a, b): the pairs of ids, the smaller one first, of pairs of blocks (ia, ib, same), where `same` says that both are one block. They are spread over all tasks before they are taken apart."""
    tasks = 16 * paired.sparkSession.sparkContext.defaultParallelism
    rows = paired.select("ia", "ib", "same").repartition(tasks)
    rows = rows.select("ib", "same", F.explode("ia").alias("x")).select("x", "same", F.explode("ib").alias("y"))
    return rows.where("x < y OR (NOT same AND x > y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
