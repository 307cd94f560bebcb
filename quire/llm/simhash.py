"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 4 or fewer differing bits have a point within 2 bits of both. So every different fingerprint emits
all variants within HALF = 2 bits, and fingerprints that share a variant are near: verified, then linked.

The 2081 variants are emitted in two steps. A row goes to each variant of the first k bits (79 rows at k = 12), and
the task that gets a prefix makes the variants of the other bits in bounded portions. k follows the number of
fingerprints, so that a prefix has about PER_KEY of them. Whatever shares a variant is mutually near, so a task emits a
spanning forest of what it found, never pairs. Equal fingerprints are merged before (map-side combined), so groups of
copies of any size are one point; a dense cluster's variants spread over many prefixes.

Components come from contraction: every node points at its neighbour of least random priority, pointers are doubled,
edges are relabelled and the rest contracted again; each round is written to the shared folder.

Nulls: a null or wordless text has fingerprint zero, linked like any other; null doc_ids are larger than any other
(component_id is null only if all are). Repeated rows share everything. Very long texts are read whole, in portions.
Further columns pass through near_dedup(); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, dropped, is_small, keep_rows, row_hash, small, staged, table

SHINGLE = 4
RADIUS = 4
HALF = RADIUS // 2
SEED = 42
PER_KEY = 512
#: Variants that a task holds at once (12 bytes each).
PORTION = 4_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """64 bits; bit i is 1 if set in over half of the shingles' XXH64."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    m = n - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, m, 65536):
        to = min(m, at + 65536)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + SHINGLE - 1 : to + SHINGLE - 1].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > m
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint_column(text: str = "text") -> Column:
    """The fingerprint as a signed long."""

    def fingerprints(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in text.to_pylist()], np.uint64).view(np.int64))

    return F.arrow_udf(fingerprints, "bigint")(F.col(text).cast("string"))


def prefix_bits(n: int) -> int:
    """Bits of the prefix by which variants are dealt, for n fingerprints."""
    return min(32, max(12, ceil(log2(max(1, n) / PER_KEY))))


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(bits), r)]


class _Forest:
    """Union-find over the rows of one portion of work; unions of different trees are the links to emit."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def _meet(fps: np.ndarray, rows: np.ndarray, left: np.ndarray, bits: int, forest: _Forest) -> None:
    """Links among rows whose variants agree above the low bits; left: flips that each row still has."""
    if len(rows) < 2:
        return
    per = np.array([len(_masks_cached(bits, r)) for r in range(HALF + 1)])
    if bits > 4 and int(per[left].sum()) > PORTION:
        # Deal by the next 4 bits, as rows were dealt by the prefix.
        low = bits - 4
        own = (fps[rows] >> np.uint64(low)) & np.uint64(15)
        for value in range(16):
            used = np.bitwise_count(own ^ np.uint64(value)).astype(np.int64)
            ok = used <= left
            _meet(fps, rows[ok], left[ok] - used[ok], low, forest)
        return
    variants, owners = [], []
    low_mask = np.uint64((1 << bits) - 1)
    for r in range(HALF + 1):
        mine = rows[left == r]
        if len(mine):
            m = _masks_cached(bits, r)
            variants.append(((fps[mine] & low_mask)[:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(mine.astype(np.int32), len(m)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v, kind="stable")
    v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    pairs = np.unique(o[same].astype(np.int64) * len(fps) + o[same + 1])
    a, b = pairs // len(fps), pairs % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS  # verified, though two halves never exceed the radius
    for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
        forest.join(i, j)


_mask_cache: dict[tuple[int, int], np.ndarray] = {}


def _masks_cached(bits: int, most: int) -> np.ndarray:
    if (bits, most) not in _mask_cache:
        _mask_cache[bits, most] = np.array(_masks(bits, most), np.uint64)
    return _mask_cache[bits, most]


def _links_of(key: int, fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest of one prefix's fingerprints."""
    fps = np.unique(fps)
    used = np.bitwise_count((fps >> np.uint64(64 - k)) ^ np.uint64(key)).astype(np.int64)
    forest = _Forest(len(fps))
    _meet(fps, np.arange(len(fps)), HALF - used, 64 - k, forest)
    at = np.array(forest.links, np.int64).reshape(-1, 2)
    return fps[at[:, 0]], fps[at[:, 1]]


def _link_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, fp) in order of key to batches of links (u, v)."""
    held_key, held = -1, []

    def out(key: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        u, v = _links_of(key, np.concatenate(parts), k)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if keys[s] != held_key:
                if sum(map(len, held)) > 1:
                    yield out(held_key, held)
                held_key, held = int(keys[s]), []
            held.append(fps[s:e])
    if sum(map(len, held)) > 1:
        yield out(held_key, held)


def links(points: DataFrame, n: int) -> DataFrame:
    """points (fp, different) to links (u, v) whose components are those of all pairs within RADIUS bits."""
    k = prefix_bits(n)
    top = F.shiftrightunsigned("fp", 64 - k)
    dealt = points.select(F.explode(F.transform(F.array(*[F.lit(m) for m in _masks(k, HALF)]), lambda m: m.cast("bigint").bitwiseXOR(top))).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _link_batches(it, k), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) to a staged table (node, root) of every node that has an edge."""
    edges = staged(edges.filter("u <> v"), "edges")
    label = staged(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), c.alias("id"))
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("to")))
        up = both.groupBy("node").agg(F.min(rank(F.col("to"))).alias("m"))
        up = staged(up.select("node", F.least("m", rank(F.col("node")))["id"].alias("up")), "parents")
        for _ in range(2):  # pointers lead to ever smaller priorities, so doubling ends at local least ones
            s = small(up.select(F.col("node").alias("s_node"), F.col("up").alias("s_up")), up)
            nearer = staged(up.join(s, up["up"] == s["s_node"]).select("node", F.col("s_up").alias("up")), "parents")
            dropped(up)
            up = nearer
        s = small(up.select(F.col("node").alias("s_node"), F.col("up").alias("s_up")), up)
        renamed = staged(label.join(s, label["root"] == s["s_node"], "left").select("node", F.coalesce("s_up", "root").alias("root")), "labels")
        dropped(label)
        label = renamed
        moved = edges.join(s, edges["u"] == s["s_node"]).select(F.col("s_up").alias("u"), "v")
        moved = moved if is_small(up) else staged(moved, "moved")
        left = moved.join(s, moved["v"] == s["s_node"]).select("u", F.col("s_up").alias("v"))
        left = staged(left.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        dropped(edges, moved, up)
        edges = left
    return label


def grouped(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_hash, fp, component_id and kept (one row, of the smallest doc_id) of every row of docs."""
    bounded_batches(docs.sparkSession)
    rows = staged(docs.select("doc_id", row_hash(docs).alias("row_hash"), fingerprint_column(text).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_hash")).alias("first")
    points = staged(rows.groupBy("fp").agg(first), "points")
    found = components(links(points.select("fp"), points._staged_rows or points.count()))
    near = small(found)
    rooted = points.join(near, points["fp"] == near["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    of = staged(rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("c_fp"), "least"), "components")
    dropped(found, points, rooted, least)
    out = rows.join(of, rows["fp"] == of["c_fp"])
    kept = rows["doc_id"].eqNullSafe(F.col("least.doc_id")) & (F.col("row_hash") == F.col("least.row_hash"))
    return out.select("doc_id", "row_hash", "fp", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, all columns as they were."""
    return keep_rows(docs, grouped(docs, text).select("doc_id", "row_hash", "kept"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
