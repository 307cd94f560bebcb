"""Exact duplicates by deterministic block naming.

Texts lose their ASCII white space and are cut into blocks of BLOCK code points. Blocks are sorted by (60-bit hash,
content); a block's name is the integer of its hash, and, where different blocks share a hash, its rank among them after
a point. Then adjacent names are paired and named in the same way, level by level, until each document has one name; a
last round names (number of blocks, name). Equal names mean equal texts: the rank tells apart whatever shares a hash,
however many, so no collision can join different texts.

Each level first looks for hashes with different contents (least and greatest content of each hash, combined on the map
side). Only members with such a hash are ranked, by a window over each hash, and joined back, broadcast if they are few
(counted). In practice there are none (about n^2 / 2^61), and naming is a projection.

Nulls: a null text counts as empty; a null doc_id is larger than any other. Repeated rows are one group; of rows equal
in doc_id and length one, and only one, is kept. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACES, keep_rows, let, row_hash, small, staged, table, text_or_empty

BLOCK = 4096
HASH_BITS = 60


def normalised(col: str | Column) -> Column:
    """Without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(text_or_empty(col), SPACES, "")


def blocks_of(norm: Column, size: int) -> Column:
    """Blocks of size code points, one empty block for an empty text."""
    found = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(norm) <= size, F.array(norm)).otherwise(found)


def _bucket(member: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(member), 64 - bits)


def ranks(members: DataFrame, bits: int) -> DataFrame | None:
    """bucket, member and rank (from 1) of the members that are not the least of their bucket; None if there are none."""
    m = members.select(_bucket(F.col("member"), bits).alias("bucket"), "member")
    shared = m.groupBy("bucket").agg(F.min("member").alias("low"), F.max("member").alias("high")).filter("low <> high")
    shared = staged(shared.select(F.col("bucket").alias("s_bucket")), "shared_hashes")
    if shared.isEmpty():
        return None
    found = m.join(small(shared), m["bucket"] == F.col("s_bucket"), "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("member")) - 1
    return staged(found.withColumn("rank", rank).filter("rank > 0").select(F.col("bucket").alias("r_bucket"), F.col("member").alias("r_member"), "rank"), "name_ranks")


def _plain(member: Column, bits: int) -> Column:
    return _bucket(member, bits).cast("string")


def named(rows: DataFrame, members: Column, into: str, ranked: DataFrame | None, bits: int) -> DataFrame:
    """rows (rid) with an array of the names of an array of members."""
    if ranked is None:
        return rows.withColumn(into, let(members, lambda all_: F.transform(all_, lambda m: _plain(m, bits))))
    rows = staged(rows.withColumn("_members", members), "members")
    each = rows.select(F.col("rid").alias("m_rid"), F.posexplode("_members").alias("pos", "member"))
    found = each.join(small(ranked), (_bucket(each["member"], bits) == F.col("r_bucket")) & (each["member"] == F.col("r_member")), "left")
    name = F.concat_ws(".", _plain(F.col("member"), bits), F.col("rank").cast("string"))
    names = found.groupBy("m_rid").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).alias("_sorted"))
    back = rows.join(names, rows["rid"] == names["m_rid"], "left")
    return back.withColumn(into, F.coalesce(F.col("_sorted")["name"], F.array().cast("array<string>"))).drop("_members", "_sorted", "m_rid")


def _pairs(names: Column) -> Column:
    """Adjacent names as members, the last of an odd number alone; none of a document that is down to one name."""
    pairs = F.transform(F.sequence(F.lit(0), ((F.size(names) - 1) / 2).cast("int")), lambda i: F.concat_ws(":", F.get(names, 2 * i), F.get(names, 2 * i + 1)))
    return F.when(F.size(names) > 1, pairs).otherwise(F.array().cast("array<string>"))


def identities(docs: DataFrame, text: str = "text", block: int = BLOCK, bits: int = HASH_BITS) -> DataFrame:
    """A staged table: doc_id, row_hash, rid (unique), n_chars, text_sha256 and identity of every row of docs."""
    source = docs.select(F.col("doc_id"), row_hash(docs).alias("row_hash"), F.length(text_or_empty(text)).cast("long").alias("n_chars"), normalised(text).alias("norm"))
    cut = blocks_of(F.col("norm"), block)
    ranked = ranks(source.select(F.explode(cut).alias("member")), bits)
    at = source.withColumn("rid", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("norm", 256))
    at = named(at, cut, "names", ranked, bits)
    at = staged(at.select("doc_id", "row_hash", "rid", "n_chars", "text_sha256", "names"), "block_names").withColumn("n_blocks", F.size("names"))
    most = at.agg(F.max("n_blocks")).first()[0] or 1
    while most > 1:
        # Documents that are down to one name keep it. Each level refers to the one below once, so plans stay small.
        ranked = ranks(at.select(F.explode(let(F.col("names"), _pairs)).alias("member")), bits)
        if ranked is None:
            at = at.withColumn("names", let(F.col("names"), lambda n: F.when(F.size(n) > 1, F.transform(_pairs(n), lambda m: _plain(m, bits))).otherwise(n)))
        else:
            at = named(at, let(F.col("names"), _pairs), "next", ranked, bits).withColumn("names", F.when(F.size("next") > 0, F.col("next")).otherwise(F.col("names"))).drop("next")
        most = (most + 1) // 2
    top = F.array(F.concat_ws(":", F.col("n_blocks").cast("string"), F.get(F.col("names"), F.lit(0))))
    at = named(at, top, "identity", ranks(at.select(F.get(top, F.lit(0)).alias("member")), bits), bits)
    return staged(at.select("doc_id", "row_hash", "rid", "n_chars", "text_sha256", F.get("identity", F.lit(0)).alias("identity")), "identities")


def dedup_table(docs: DataFrame, text: str = "text", block: int = BLOCK, bits: int = HASH_BITS) -> DataFrame:
    """One row per row of docs: doc_id, row_hash, keep_id, group_size, kept, text_sha256.

    Groups are aggregated with map-side combine and joined back by a written table, so that a group of any size can be
    split among tasks.
    """
    named = identities(docs, text, block, bits)
    first = F.min(F.struct((-F.col("n_chars")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid")))
    groups = staged(named.groupBy("identity").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    groups = groups.select("identity", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size")
    return named.join(groups, "identity").select("doc_id", "row_hash", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were."""
    return keep_rows(docs, dedup_table(docs, text).select("doc_id", "row_hash", "kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_table(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
