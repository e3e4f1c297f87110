"""Hierarchical weighted hash tree: region, rack and shard are each drawn by weighted hash draws.

At every level a row draws ``-ln(u) / weight`` for each child, ``u`` a uniform value hashed from the row's id
and the child's name, and descends into the child with the smallest draw.  A child's share is its weight's
share, and a changed weight changes no other child's draw: rows move only into or out of the subtree whose
weight changed (straw draws).  Shards that join later hang below the root in a region of their own, so a
larger shard count moves rows into the new shard and nowhere else.

Defined cases: a null id draws as one fixed id; an empty table gives no rows; repeated rows share a shard and
get slots of their own; null text has size 1 (its UTF-8 bytes, none, plus 1) and the crc of no bytes; other
columns pass through untouched unless they carry an output's name, which the output replaces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Staged


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


@dataclass(frozen=True)
class Layout:
    """``base`` shards in racks of ``rack`` and regions of ``region`` racks; later shards in regions of their own."""

    base: int = 8
    rack: int = 2
    region: int = 2
    weights: dict[int, float] = field(default_factory=dict)

    def tree(self, shards: int) -> Node:
        if shards < self.base:
            raise ValueError(f"{shards} shards are fewer than the {self.base} the layout began with")
        leaf = lambda s: Node(f"s{s}", self.weights.get(s, 1.0), (), s)
        racks = [
            Node(f"k{i}", children=tuple(leaf(s) for s in range(i * self.rack, min(self.base, (i + 1) * self.rack))))
            for i in range(-(-self.base // self.rack))
        ]
        regions = [
            Node(f"r{i}", children=tuple(racks[i * self.region : (i + 1) * self.region]))
            for i in range(-(-len(racks) // self.region))
        ]
        late = [Node(f"r+{s}", children=(Node(f"k+{s}", children=(leaf(s),)),)) for s in range(self.base, shards)]
        return Node("root", children=(*regions, *late))


def draw(key: Column, node: Node) -> Column:
    """-ln(u)/weight with 53 uniform bits; never 0 or 1, so never infinite."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / F.lit(float(node.total))


def descend(key: Column, node: Node) -> Column:
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    best = F.array_min(
        F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)])
    ).getField("i")
    out = descend(key, node.children[-1])
    for i in range(len(node.children) - 2, -1, -1):
        out = F.when(best == F.lit(i), descend(key, node.children[i])).otherwise(out)
    return out


def assign(df: DataFrame, shards: int = 8, key: str = "doc_id", layout: Layout | None = None, name: str = "shard") -> DataFrame:
    layout = layout or Layout(base=shards)
    return df.withColumn(name, descend(F.col(key), layout.tree(shards)).cast("int"))


def with_slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Numbers the rows of every shard from 0 without gaps and without gathering a shard in one task.

    The rows are staged with the task and place each had; a shard's slots then run through the tasks in order.
    Only the counts by task and shard are summed over, a few rows a task.
    """
    at = F.monotonically_increasing_id()
    staged = Staged(df.withColumn("__task", F.shiftright(at, 33).cast("int")).withColumn("__row", at), "shards").df
    counts = staged.groupBy("__task", shard).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(
        "__task",
        shard,
        (F.sum("__n").over(Window.partitionBy(shard).orderBy("__task")) - F.col("__n")).alias("__before"),
    )
    inside = F.row_number().over(Window.partitionBy("__task", shard).orderBy("__row")) - 1
    return (
        staged.join(starts, ["__task", shard])
        .withColumn(slot, (F.col("__before") + inside).cast("long"))
        .drop("__task", "__row", "__before")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The key law over documents, with the shard that one more shard would give."""
    layout = Layout(base=shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(F.col("doc_id"), layout.tree(shards)).cast("int").alias("shard"),
        descend(F.col("doc_id"), layout.tree(shards + 1)).cast("int").alias("grown_shard"),
    )
    return with_slots(df)
