"""Sharding by a hierarchical weighted hash tree.

A document goes down from region to rack to shard. At each level every child draws ln(u) / weight, with u a hash of the
document's key and the child's path, and the largest draw wins: a child is chosen in proportion to its weight. A draw
depends on nothing but its own child, so a changed weight moves documents only to or from that child, and what happens below
one node never moves a document of another. The placement is one column expression; nothing is shuffled or looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tree = dict[str, tuple[float, "Tree | None"]]

LEVELS = ("region", "rack", "shard")
#: The tree of the registered query: weights stand for capacity.
TREE: Tree = {
    "east": (3.0, {"e1": (2.0, {"s0": (1.0, None), "s1": (1.0, None), "s2": (2.0, None)}), "e2": (1.0, {"s0": (1.0, None), "s1": (1.0, None)})}),
    "north": (2.0, {"n1": (1.0, {"s0": (1.0, None), "s1": (3.0, None)}), "n2": (1.0, {"s0": (1.0, None), "s1": (1.0, None)})}),
    "west": (1.0, {"w1": (1.0, {"s0": (2.0, None), "s1": (1.0, None)}), "w2": (0.5, {"s0": (1.0, None)})}),
}
#: Light columns that stand in for a missing id, so that rows without one are spread.
INSTEAD = ("source", "lang", "n_chars")


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"


def _draw(path: str, weight: float, duck: bool) -> str:
    cut = f"substr(md5(concat(k, {_text(':' + path)})), 1, 8)"
    number = f"CAST('0x' || {cut} AS BIGINT)" if duck else f"CAST(conv({cut}, 16, 10) AS BIGINT)"
    return f"ln(({number} + 0.5e0) / 4294967296e0) / {weight!r}e0"


def choice(children: Tree, above: str = "", duck: bool = False) -> str:
    """SQL for the child that wins; null if none has a weight over 0. Of equal draws the greater name wins."""
    live = [(name, weight) for name, (weight, _) in sorted(children.items()) if weight > 0]
    if not live:
        return "CAST(NULL AS STRING)"
    if duck:
        return "list_sort([" + ", ".join(f"{{'d': {_draw(above + n, w, True)}, 'n': {_text(n)}}}" for n, w in live) + "], 'DESC')[1].n"
    return "array_max(array(" + ", ".join(f"named_struct('d', {_draw(above + n, w, False)}, 'n', {_text(n)})" for n, w in live) + ")).n"


def levels(tree: Tree, duck: bool = False) -> list[str]:
    """SQL of each level, in terms of k (the key) and the levels above."""
    out, nodes = [], {(): tree}
    for depth, level in enumerate(LEVELS):
        cases = []
        for path, children in nodes.items():
            when = " AND ".join(f"{LEVELS[i]} = {_text(p)}" for i, p in enumerate(path))
            pick = choice(children, "".join(p + "/" for p in path), duck)
            cases.append(f"WHEN {when} THEN {pick}" if when else pick)
        out.append(cases[0] if not depth else f"CASE {' '.join(cases)} END")
        nodes = {(*path, name): below for path, children in nodes.items() for name, (_, below) in children.items() if below}
    return out


def place(docs: DataFrame, tree: Tree = TREE, key: str = "doc_id", instead: tuple[str, ...] = INSTEAD) -> DataFrame:
    """(doc_id, region, rack, shard) of each row of docs.

    Rows with equal keys go to one place. A row whose key is null is placed by the columns of `instead` that the table has
    (nulls in them are left out). Children of weight 0 or less get nothing; where a node has no other, the levels below are
    null. Texts and further columns are not read. An empty table gives no rows.
    """
    light = [F.col(c).cast("string") for c in instead if c in docs.columns]
    out = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("string"), F.concat_ws("|", F.lit(""), *light)).alias("k"))
    for level, sql in zip(LEVELS, levels(tree)):
        out = out.withColumn(level, F.expr(sql))
    return out.select("doc_id", *LEVELS)


def shards(docs: DataFrame, tree: Tree = TREE, key: str = "doc_id") -> DataFrame:
    """docs with region, rack and shard (in place of columns that were called so), all others as they are."""
    names = [c for c in docs.columns if c.lower() not in LEVELS]
    light = [F.col(c).cast("string") for c in INSTEAD if c in docs.columns]
    out = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(key).cast("string"), F.concat_ws("|", F.lit(""), *light)).alias("k"))
    for level, sql in zip(LEVELS, levels(tree)):
        out = out.withColumn(level, F.expr(sql))
    return out.select("row.*", *LEVELS)


def _oracle() -> str:
    region, rack, shard = levels(TREE, True)
    return f"""
WITH a AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), concat_ws('|', '', source, lang, CAST(n_chars AS VARCHAR))) AS k FROM documents),
     b AS (SELECT *, {region} AS region FROM a),
     c AS (SELECT *, {rack} AS rack FROM b)
SELECT doc_id, region, rack, {shard} AS shard FROM c
"""


ORACLE = _oracle()
