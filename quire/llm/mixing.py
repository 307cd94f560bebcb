"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document has a place in its source's permutation, from a hash of its doc_id and of its number among rows that
   equal it in every column; the permutation is cut into BLOCKS blocks. Words per (source, block) are aggregated once.
2. Sources share EPOCHS of all words by weight; a target stops at CAP times the source's words and the excess goes to
   the others by weight (water filling, in closed form by window functions over one row per source).
3. A source gives target // words whole passes and then its permutation up to the document that is nearest the rest of
   its target: an exact quota of blocks, the last of which may be partial.
4. The quotas are split among the output shards by a binary tree: a node's left half gets a multivariate-hypergeometric
   draw of the node's block quotas (source after source, each an urn without replacement), the right half the rest.
   The shards then own disjoint runs of each source's permuted blocks, and shuffle them locally.

Only documents of the block where a quota ends are ordered by a window; all else is a projection. Draws are hashes, so
reruns agree, and lost tasks redo the same draws.

Nulls: a null text has no words; a null source is a source of its own, last in order; a null doc_id has a place like
any other. Documents without words are taken with their place (0 words). Rows equal in every column are numbered (by
salted runs, however many there are) and have places of their own, so some may be taken once more than others. Very long
texts count with all their words. An empty table gives no rows. Further columns are kept by deal() and read only to tell
rows apart.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, row_hash, small, staged, table, text_or_empty, whole

BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SHARDS = 8
#: Runs in which equal rows are numbered.
SALTS = 64


def n_words(col: str | Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def place(seed: int, occurrence: Column, doc_id: str = "doc_id") -> Column:
    """63 bits: the place in the source's permutation."""
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed), F.lit("mix"), occurrence), 1)


def repeated(keys: DataFrame) -> DataFrame | None:
    """Hashes of the rows (_rh) that are there more than once; None if there are none."""
    found = staged(keys.groupBy("_rh").count().filter("count > 1").select(F.col("_rh").alias("_t")), "mix_repeated")
    return None if found.isEmpty() else found


def numbered(rows: DataFrame, many: DataFrame | None) -> DataFrame:
    """rows (_rh, ...) with _occ, their number among equal rows from 0. Any numbering is as good: such rows are equal.

    Only repeated rows move. They are numbered in SALTS runs each, which start where the runs before them end.
    """
    if many is None:
        return rows.withColumn("_occ", F.lit(0).cast("long"))
    t = small(many)
    one = rows.join(t, rows["_rh"] == t["_t"], "left_anti").withColumn("_occ", F.lit(0).cast("long"))
    salted = staged(rows.join(t, rows["_rh"] == t["_t"], "left_semi").withColumn("_run", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "mix_runs")
    before = F.sum("count").over(Window.partitionBy("_rh").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = salted.groupBy("_rh", "_run").count().select(F.col("_rh").alias("s_rh"), F.col("_run").alias("s_run"), F.coalesce(before, F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_rh", "_run").orderBy(F.lit(0))) - 1
    inside = salted.withColumn("_at", at)
    put = inside.join(starts, (inside["_rh"] == starts["s_rh"]) & (inside["_run"] == starts["s_run"]))
    return one.unionByName(put.select(*rows.columns, (F.col("_start") + F.col("_at")).cast("long").alias("_occ")))


def block_of(u: Column) -> Column:
    return F.shiftrightunsigned(u, 63 - BLOCK_BITS).cast("int")


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """by_source (source, source_size) with weight, ordinal and target."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spent, used = F.coalesce(F.sum("most").over(fill), F.lit(0.0)), F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_w", F.sum("weight").over(everything))
    rows = rows.withColumn("level", (F.col("total") - spent) / (F.col("all_w") - used)).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "ordinal", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def _draw(node: Column, source: Column, step: Column, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(node, source, step, F.lit(seed), F.lit("urn")), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _hypergeometric(pool: Column, marked: Column, taken: Column, node: Column, source: Column, seed: int) -> Column:
    """How many of marked are among taken draws from pool without replacement: one urn step for each marked one."""
    steps = F.when(marked > 0, F.sequence(F.lit(1).cast("long"), marked)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda x, i: x + F.when(_draw(node, source, i, seed) * (pool - i + 1) < (taken - x), 1).otherwise(0).cast("long"))


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """quotas (ordinal, quota) to one row per ordinal: ends, the running number of blocks up to each output shard.

    Shards get equal numbers of blocks, one apart at most. One row per node of a tree of shards leaves.
    """
    root = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("long").alias("s"), F.col("quota").cast("long").alias("q")))).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["q"])
    nodes = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "counts", total.alias("all"))
    upto = lambda k, n: F.floor(n * k / shards).cast("long")  # noqa: E731  blocks of the shards before k
    nodes = nodes.withColumn("whole", F.col("all"))
    for _ in range(ceil(log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        nodes = nodes.withColumn("mid", mid).withColumn("left_n", upto(F.col("mid"), F.col("whole")) - upto(F.col("lo"), F.col("whole")))
        node = F.col("lo") * F.lit(1 << 20) + F.col("hi")
        start = F.struct(F.col("all").alias("pool"), F.col("left_n").alias("take"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, c: Column, node: Column = node) -> Column:
            x = _hypergeometric(a["pool"], c["q"], a["take"], node, c["s"], seed)
            return F.struct((a["pool"] - c["q"]).alias("pool"), a["take"].alias("take"), F.concat(a["out"], F.array(x)).alias("out"))

        # take falls by each draw; the draw is the last of out, so the fold subtracts it on the way in.
        def fold(a: Column, c: Column) -> Column:
            last = F.coalesce(F.try_element_at(a["out"], F.lit(-1)), F.lit(0).cast("long"))
            return step(F.struct(a["pool"].alias("pool"), (a["take"] - last).alias("take"), a["out"].alias("out")), c)

        nodes = nodes.withColumn("left", F.aggregate("counts", start, fold)["out"])
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.zip_with("counts", "left", lambda c, x: F.struct(c["s"].alias("s"), x.alias("q"))).alias("counts"), F.col("left_n").alias("all")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("counts", "left", lambda c, x: F.struct(c["s"].alias("s"), (c["q"] - x).alias("q"))).alias("counts"), (F.col("all") - F.col("left_n")).alias("all")),
        )
        nodes = nodes.select("whole", F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(F.slice(halves, 2, 1))).alias("n")).select("whole", "n.*")
        nodes = nodes.filter(F.col("hi") > F.col("lo"))
    leaves = nodes.select("lo", F.explode("counts").alias("c")).select(F.col("c.s").alias("ordinal"), "lo", F.col("c.q").alias("q"))
    runs = leaves.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("lo", "q"))).alias("runs"))
    ends = F.transform("runs", lambda r: F.aggregate(F.filter("runs", lambda o: o["lo"] <= r["lo"]), F.lit(0).cast("long"), lambda a, o: a + o["q"]))
    return runs.select(F.col("ordinal").cast("int").alias("ordinal"), ends.alias("ends"))


def plan(items: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """items (source, size, u, row_hash) to two staged tables: one row per source, and one per (source, block)."""
    by_block = staged(items.groupBy("source", block_of(F.col("u")).alias("block")).agg(F.sum("size").alias("words")), "mix_blocks")
    goal = targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = staged(goal.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix_targets")
    along = Window.partitionBy("source").orderBy("block")
    ranked = by_block.withColumn("rank", F.row_number().over(along) - 1).withColumn("before", F.sum("words").over(along) - F.col("words"))
    g = small(goal.withColumnRenamed("source", "g_source"))
    blocks = staged(ranked.join(g, ranked["source"].eqNullSafe(g["g_source"])).drop("g_source"), "mix_ranked")
    # The block in which a pass ends is the last that starts at or before the rest; only its documents are put in order.
    last = blocks.filter(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max_by(F.struct("block", "before", "rest", "rank"), "block").alias("m")).select(F.col("source").alias("l_source"), "m.*")
    last = staged(last, "mix_last")
    edge = small(last)
    docs = items.join(edge, items["source"].eqNullSafe(edge["l_source"]) & (block_of(items["u"]) == edge["block"]))
    places = docs.groupBy("source", "u", "row_hash").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    cum = F.sum("size").over(Window.partitionBy("source").orderBy("u", "row_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = places.withColumn("cum", F.col("before") + cum).filter(F.col("cum") - F.col("size") / 2.0 <= F.col("rest"))
    cuts = fits.groupBy("source").agg(F.max(F.struct("u", "row_hash")).alias("cut")).select(F.col("source").alias("c_source"), "cut")
    start = F.struct((F.shiftleft(F.col("block").cast("long"), 63 - BLOCK_BITS) - 1).alias("u"), F.lit(2**63 - 1).alias("row_hash"))
    ended = last.join(cuts, last["l_source"].eqNullSafe(cuts["c_source"]), "left")
    ended = ended.select("l_source", F.coalesce("cut", start).alias("cut"), (F.col("rank") + F.col("cut").isNotNull().cast("int")).alias("part"))
    many = blocks.groupBy("source").agg(F.count("*").alias("n_blocks")).select(F.col("source").alias("n_source"), "n_blocks")
    per = goal.join(ended, goal["source"].eqNullSafe(ended["l_source"]), "left").join(many, goal["source"].eqNullSafe(many["n_source"]))
    quota = F.col("passes") * F.col("n_blocks") + F.when(F.col("rest") > 0, F.coalesce("part", F.lit(0))).otherwise(0)
    nothing = F.struct(F.lit(-1).cast("long").alias("u"), F.lit(0).cast("long").alias("row_hash"))
    per = staged(per.select("source", "ordinal", "source_size", "target", "passes", "n_blocks", F.when(F.col("rest") > 0, F.coalesce("cut", nothing)).otherwise(nothing).alias("cut"), quota.cast("long").alias("quota")), "mix_plan")
    runs = split_quotas(per.select("ordinal", "quota"), shards, seed).withColumnRenamed("ordinal", "r_ordinal")
    per = staged(per.join(runs, per["ordinal"] == runs["r_ordinal"], "left").drop("r_ordinal"), "mix_split")
    return per, blocks.select("source", "block", "rank")


def taken(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """_doc (docs' columns) with _size, _source_size, _target, _copies and _shards (the output shard of each copy)."""
    size, rh = n_words("text").alias("_size"), row_hash(docs).alias("_rh")
    keys = staged(docs.select("doc_id", F.col("source").alias("_source"), size, rh), "mix_keys")
    many = repeated(keys)
    items = numbered(keys, many).select(F.col("_source").alias("source"), F.col("_size").alias("size"), place(seed, F.col("_occ")).alias("u"), F.col("_rh").alias("row_hash"))
    items = staged(items, "mix_items")
    keyed = numbered(docs.select(whole(docs), F.col("source").alias("_source"), rh, size), many)
    u = place(seed, F.col("_occ"), "_doc.doc_id")
    keyed = keyed.withColumn("_u", u).withColumn("_block", block_of(F.col("_u")))
    per, blocks = plan(items, weights, share, cap, shards, seed)
    p = small(per.select(F.col("source").alias("p_source"), F.struct("source_size", "target", "passes", "n_blocks", "cut", "ends").alias("_p")))
    b = small(blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.col("rank").alias("_rank")))
    out = keyed.join(p, keyed["_source"].eqNullSafe(p["p_source"])).join(b, keyed["_source"].eqNullSafe(b["b_source"]) & (keyed["_block"] == b["b_block"]))
    part = F.struct(F.col("_u").alias("u"), F.col("_rh").alias("row_hash")) <= F.col("_p.cut")
    copies = (F.col("_p.passes") + part.cast("int")).cast("int")
    of_pass = lambda k: F.size(F.filter(F.col("_p.ends"), lambda e: e <= F.col("_rank") + F.col("_p.n_blocks") * k)).cast("int")
    rounds = F.when(F.col("_copies") > 0, F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_copies", copies).withColumn("_shards", F.transform(rounds, of_pass))
    return out.select("_doc", "_size", F.col("_p.source_size").alias("_source_size"), F.col("_p.target").alias("_target"), "_copies", "_shards")


def deal(docs: DataFrame, shards: int = SHARDS, seed: int = 42, shard_column: str | None = None, **how) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy, by output shard and shuffled inside it.

    With shard_column the output shard comes along, under that name; it must not be a name of docs.
    """
    if shard_column in docs.columns:
        raise ValueError(f"{shard_column} is a column of the documents")
    out = taken(docs, shards=shards, seed=seed, **how).select("_doc", F.posexplode("_shards").alias("_copy", "_shard"))
    return out.repartition(F.col("_shard"), F.pmod(F.xxhash64("_doc.doc_id", "_copy"), F.lit(64))).sortWithinPartitions("_shard", F.xxhash64("_doc.doc_id", "_copy", "_shard", F.lit(seed))).select("_doc.*", *([F.col("_shard").alias(shard_column)] if shard_column else []))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    words = (F.col("_copies") * F.col("_size")).cast("long").alias("taken")
    return taken(docs).select("_doc.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), words, F.col("_copies").alias("copies"), F.col("_shards").alias("shards"))
