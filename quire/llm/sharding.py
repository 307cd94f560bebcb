"""Hierarchical weighted hash tree: shards are the leaves of regions and racks, reached by weighted hash draws.

A shard draws -ln(u) / weight, u from a hash of the document's key and the shard. A rack's draw is the least of its
shards', a region's the least of its racks': such a least draw is exponential with the whole weight below, so every
level is drawn in proportion to weight. A key descends from the region of the least draw to its rack and shard of the
least draw. As draws above come from draws below, a change moves keys only into a shard that gains weight or out of one
that loses it, never between others, whatever the tree's shape: one more shard takes rows only into itself, for every
number of shards. The tree is one literal of arrays in arrays, so the plan does not grow with its levels; a row costs
one hash per shard.

Slots are numbered in hash runs of about RUN rows, whose offsets are prefix sums; the run also takes a number of the
row in its input partition, so that rows of one key spread over runs.

Nulls: a null key is a key like any other; a null text has no bytes (size 1, crc32 0). Repeated keys share a shard and
get different slots. An empty table gives no rows. Further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import small, staged, table, text_or_empty

#: Rows of a run, about; runs of a shard at least; numbers that spread the rows of one key.
RUN = 100_000
LEAST_RUNS = 64
SALTS = 64


@dataclass(frozen=True)
class Shard:
    id: int
    weight: float = 1.0


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[Shard, ...]

    @property
    def weight(self) -> float:
        return sum(s.weight for s in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


@dataclass(frozen=True)
class HashTree:
    regions: tuple[Region, ...]

    @classmethod
    def of(cls, shards: int, per_rack: int = 4, racks: int = 4) -> HashTree:
        """The tree that a number of shards decides: racks and regions are filled in order of shard ids."""
        if shards < 1:
            raise ValueError("a tree has one shard at least")
        found: dict[int, dict[int, list[Shard]]] = {}
        for s in range(shards):
            rack = s // per_rack
            found.setdefault(rack // racks, {}).setdefault(rack, []).append(Shard(s))
        return cls(tuple(Region(f"region{g}", tuple(Rack(f"rack{r}", tuple(own)) for r, own in of.items())) for g, of in found.items()))

    def shards(self) -> list[Shard]:
        return [s for g in self.regions for r in g.racks for s in r.shards]

    def literal(self) -> Column:
        """array (regions) of array (racks) of array of (id, weight); shards without weight get no rows and are left out."""
        if not any(s.weight > 0 for s in self.shards()):
            raise ValueError("no shard has weight")
        one = lambda s: f"named_struct('id', {s.id}, 'weight', {float(s.weight)!r}D)"
        rack = lambda r: "array(" + ", ".join(one(s) for s in r.shards if s.weight > 0) + ")"
        region = lambda g: "array(" + ", ".join(rack(r) for r in g.racks if r.weight > 0) + ")"
        return F.expr("array(" + ", ".join(region(g) for g in self.regions if g.weight > 0) + ")")


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight; u in (0, 1) has 53 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / weight


def place(key: Column, tree: HashTree) -> Column:
    """The shard of a key: level by level, the child of the least draw."""
    leaf = lambda s: F.struct(draw(key, s["id"], s["weight"]).alias("draw"), s["id"].alias("id"))
    rack = lambda r: F.array_min(F.transform(r, leaf))
    region = lambda g: F.array_min(F.transform(g, rack))
    return F.array_min(F.transform(tree.literal(), region))["id"].cast("int")


def descend(df: DataFrame, tree: HashTree, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """df with the shard of each key in column into; a plain projection, without a shuffle."""
    return df.withColumn(into, place(F.col(key), tree))


def with_slots(df: DataFrame, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """df with a gapless slot in each shard.

    Rows are written with their run, counted by run, and numbered inside it. Runs grow in number with the rows; the
    table of their offsets is broadcast only if it is small.
    """
    salted = staged(df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "shard_rows")
    runs = max(LEAST_RUNS, -(-(salted._staged_rows or salted.count()) // RUN))
    at = salted.withColumn("_run", F.pmod(F.xxhash64(F.col(key), F.col("_salt"), F.lit("slot")), F.lit(runs)))
    sizes = staged(at.groupBy(shard, "_run").agg(F.count("*").alias("_n")), "shard_runs")
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = small(staged(sizes.select(shard, "_run", F.coalesce(before, F.lit(0)).alias("_offset")), "shard_offsets"))
    order = Window.partitionBy(shard, "_run").orderBy(F.col(key).asc_nulls_first(), *[c for c in df.columns if c not in (shard, key)])
    numbered = at.withColumn("_at", F.row_number().over(order))
    return numbered.join(offsets, [shard, "_run"]).withColumn("slot", (F.col("_offset") + F.col("_at") - 1).cast("long")).drop("_run", "_at", "_offset", "_salt")


def shard_documents(docs: DataFrame, tree: HashTree, grown: HashTree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = text_or_empty("text")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = descend(descend(rows, tree), grown, into="grown_shard")
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), HashTree.of(8), HashTree.of(9))
