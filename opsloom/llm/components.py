"""Connected components of a table of links, by contraction on DataFrames."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from opsloom.llm.common import Tables

#: Links of numbers or texts that one task finishes; others go by rounds.
FEW = 10_000


def undirected(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contracted(edges: DataFrame, round_: int) -> DataFrame:
    """id and to: the first of each id and its neighbours. The smallest is first in even rounds, the least hash in odd ones."""

    def place(end: str):
        order = F.xxhash64(F.lit(round_), end) if round_ % 2 else F.lit(0).cast("long")
        return F.struct(order.alias("order"), F.col(end).alias("id"))

    both = edges.select("a", "b").union(edges.select("b", "a"))
    near = both.groupBy("a").agg(F.min(place("b")).alias("near"))
    return near.select(F.col("a").alias("id"), F.least("near", place("a"))["id"].alias("to"))


def settled(edges: DataFrame) -> DataFrame:
    """id and to, the smallest id of the component, of FEW edges at most."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, batch = {}, None

        def end(x):
            while (y := to.setdefault(x, x)) != x:
                to[x] = to[y]
                x = to[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = end(a), end(b)
                to[max(a, b)] = min(a, b)
        if batch is not None:
            id_type = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(list(to), id_type), pa.array([end(x) for x in list(to)], id_type)], names=["id", "to"])

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, to {kind}")


def components(links: DataFrame) -> DataFrame:
    """`links` has the columns a and b, of one type. Returns id and comp, the smallest id of the component, for every id
    in a link. In each round ids go to the first of themselves and their neighbours, and the links between what is still
    apart go on to the next, until FEW are left. A random order leaves two thirds of the ids on average, whatever the
    links, so all rounds together read rows in proportion to the links; chains don't add rounds over all ids. The rounds
    between go by the smallest id, which takes all ids around one source at once. Each round's tables lie in the shared
    folder. Null ends are ignored; no links give no rows."""
    tables = Tables(links.sparkSession, "components")
    edges, steps = tables.write(undirected(links), "edges"), []
    few = FEW if isinstance(edges.schema["a"].dataType, IntegralType | StringType) else 0
    while edges.count() > few:
        step = tables.write(contracted(edges, len(steps)), "steps")
        steps.append(step)
        a, b = (step.select(F.col("id").alias(end), F.col("to").alias(f"to_{end}")) for end in ("a", "b"))
        moved = edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        before, edges = edges, tables.write(undirected(moved), "edges")
        tables.drop(before)
    ends = settled(edges)
    for step in reversed(steps):
        later = ends.select(F.col("id").alias("to"), F.col("to").alias("end"))
        ends = step.join(later, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    ends = tables.write(ends, "ends")
    # The smallest id of a component needn't be its end where rounds went by hashes.
    smallest = ends.groupBy("to").agg(F.min("id").alias("comp"))
    labels = tables.write(ends.join(smallest, "to").select("id", "comp"), "labels") if steps else ends.withColumnRenamed("to", "comp")
    tables.drop(edges, *steps, *([ends] if steps else []))
    return labels
