"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut


def forest(pairs) -> list[tuple]:
    """(node, root) for each node that isn't its tree's least: a star forest that joins what the pairs join."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _forests(schema: pa.Schema):
    def run(batches):
        pairs: list = []
        for batch in batches:
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(pairs) > 200_000:
                pairs = forest(pairs)
        if found := forest(pairs):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, schema.field(0).type), pa.array(b, schema.field(1).type)], schema=schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that can be reached, for each node of the edges' two columns.

    Each task first joins what its own edges join. Then large and small stars alternate (Kiveris et al., 2014):
    every node links its larger neighbours, then its smaller ones, to the least of them, until nothing changes.
    Every round is written to the shared folder. Least nodes are found by aggregates, so a node with very many
    neighbours is not gathered in a task. Null ends, loops and repeated edges are dropped.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    kind = pairs.schema["a"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]
    stars = pairs.mapInArrow(_forests(pa.schema([("u", arrow), ("v", arrow)])), f"u {kind}, v {kind}")
    stars = cut(stars.distinct())

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    old = None
    while (new := mark(stars)) != old:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, stars = new, cut(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct())
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
