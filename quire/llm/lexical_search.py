"""Ranked lexical search over inverted treaps.

Documents become lists of (term, occurrences), of the terms that the queries of a block use; the lists are written once,
with each document's number of terms. The numbers of documents, N and L, and each term's df come from them and fix every
posting's impact. A task then reads runs of documents (SHARD documents or POSTINGS postings, then the next run). In a
run every term has a treap: its postings are in search order of doc_id and in heap order of impact, so a subtree's root
is its greatest impact. A query goes through the treaps of all its terms at once. Its frontier holds ranges of documents,
with the topmost node of every term in the range; the sum of these nodes' impacts bounds any score in the range. The
ranges with the greatest bounds are split at the document of their strongest node: that document is scored, and the
nodes of both sides are the topmost of their side of it. A range whose bound cannot enter the best k goes with all below
it. A task's best k go on to its next run, so the bound to beat only rises.

Each task gives at most k rows a query; one rank over them, limited before the shuffle, gives the result. Nothing of
a hot term meets in one place: its postings stay with their documents.

Queries are taken in blocks (stated, from their number of terms) so that what a task holds of them is bounded
by BLOCK_TERMS or one query; every block searches all documents.

Terms are maximal runs of characters that are not ASCII or are ASCII letters and digits, with A-Z lower-cased. Nulls: a
null text has no terms; a null item or doc_id is reported as null, and a null doc_id ranks last among equal scores.
Repeated documents rank one by one, repeated items count as one query each and give equal rows; repeats of a term in an
item count. Very long texts are read whole. Empty tables give no rows. Columns beside those named are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, dropped, staged, table

K = 20
#: Terms of the queries that are searched together.
BLOCK_TERMS = 100_000
#: A run ends with either.
SHARD = 1 << 14
POSTINGS = 750_000
#: Ranges split together at first and at most.
FIRST, MOST = 16, 512

_TERM = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
TERM_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str | None) -> list[bytes]:
    """The terms in UTF-8, in order."""
    return text.encode().translate(_TERM).split() if text else []


def counted_column(text: str, vocabulary: dict[bytes, int]) -> Column:
    """n (all terms with repeats), and ids and tfs of the terms of the vocabulary."""

    def counted(text: pa.Array) -> pa.Array:
        n, ids, tfs, ends = [], [], [], [0]
        for t in text:
            terms = terms_of(t.as_py())
            n.append(len(terms))
            found = Counter(filter(vocabulary.__contains__, terms))
            ids.extend(map(vocabulary.__getitem__, found))
            tfs.extend(found.values())
            ends.append(len(ids))
        ends = pa.array(ends, pa.int32())
        columns = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["n", "ids", "tfs"])

    return F.arrow_udf(counted, "struct<n:bigint,ids:array<int>,tfs:array<bigint>>")(F.col(text).cast("string"))


class Treaps:
    """Treaps of a run's terms. Postings are in order of (term, document); a document is its rank by doc_id."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order].astype(np.int64), impact[order]
        term = term[order]
        n = len(term)
        # Heap order: impact, then a mixed document number, so that equal impacts don't make a chain.
        heap = (self.impact << 28) + (self.doc * 0x9E3779B1 & 0xFFFFFFF)
        upper = self._greater(heap, term, -1), self._greater(heap, term, 1)
        left, right = (np.where(u >= 0, heap[u], np.int64(2**63 - 1)) for u in upper)
        parent = np.where(left < right, upper[0], upper[1])
        parent = np.where((upper[0] < 0) & (upper[1] < 0), -1, parent)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        at = np.arange(n)
        under = (parent >= 0) & (at < parent)
        self.left[parent[under]] = at[under]
        under = (parent >= 0) & (at > parent)
        self.right[parent[under]] = at[under]
        self.root = np.full(n_terms, -1, np.int64)
        tops = np.flatnonzero(parent < 0)
        self.root[term[tops]] = tops

    @staticmethod
    def _greater(heap: np.ndarray, term: np.ndarray, step: int) -> np.ndarray:
        """The nearest posting of the term on one side that is above in the heap (-1: none), by jumping over what is below."""
        n = len(heap)
        to = np.arange(n) + step
        todo = np.arange(n)
        while len(todo):
            j = to[todo]
            out = (j < 0) | (j >= n)
            out[~out] = term[j[~out]] != term[todo[~out]]
            to[todo[out]] = -1
            todo, j = todo[~out], j[~out]
            low = heap[j] < heap[todo]
            todo = todo[low]
            nxt = to[j[low]]
            to[todo] = nxt
            todo = todo[nxt >= 0]
        return to

    def top(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The topmost node, at or below node, whose document is in [lo, hi); -1 if none is."""
        out = node.copy()
        todo = np.flatnonzero(out >= 0)
        while len(todo):
            at = out[todo]
            d = self.doc[at]
            low, high = d < lo[todo], d >= hi[todo]
            todo = todo[low | high]
            out[todo] = nxt = np.where(low, self.right[at], self.left[at])[low | high]
            todo = todo[nxt >= 0]
        return out

    def search(self, terms: np.ndarray, times: np.ndarray, n_docs: int, k: int, least: int, least_doc: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) of what can be among the best k, given that k have (least, least_doc) or better."""
        root = self.root[terms]
        held = root >= 0
        root, times = root[held], times[held]
        if not len(root):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        node, lo, hi = root[None, :], np.zeros(1, np.int64), np.array([n_docs])
        bound = self._bound(node, times)
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        batch = FIRST
        while len(lo):
            some = np.argpartition(-bound, batch - 1)[:batch] if len(bound) > batch else np.arange(len(bound))
            batch = min(2 * batch, MOST)
            n, a, b = node[some], lo[some], hi[some]
            strongest = np.where(n >= 0, self.impact[n] * times, -1).argmax(1)
            d = self.doc[n[np.arange(len(n)), strongest]]
            flat, wide = n.ravel(), lambda x: np.repeat(x, len(root))
            sides = self.top(np.tile(flat, 3), np.concatenate([wide(d), wide(a), wide(d + 1)]), np.concatenate([wide(d + 1), wide(d), wide(b)])).reshape(3, len(n), len(root))
            scores, docs = np.concatenate([scores, self._bound(sides[0], times)]), np.concatenate([docs, d])
            best = np.lexsort((docs, -scores))[:k]
            scores, docs = scores[best], docs[best]
            if len(best) == k and (scores[-1], -docs[-1]) > (least, -least_doc):
                least, least_doc = int(scores[-1]), docs[-1]
            rest = np.ones(len(lo), bool)
            rest[some] = False
            node = np.concatenate([node[rest], sides[1], sides[2]])
            lo, hi = np.concatenate([lo[rest], a, d + 1]), np.concatenate([hi[rest], d, b])
            bound = np.concatenate([bound[rest], self._bound(sides[1], times), self._bound(sides[2], times)])
            can = (bound > 0) & ((bound > least) | ((bound == least) & (lo < least_doc)))
            node, lo, hi, bound = node[can], lo[can], hi[can], bound[can]
        return scores, docs

    def _bound(self, node: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (np.where(node >= 0, self.impact[node], 0) * times).sum(1)


class Searcher:
    """The queries of a block, the weights of their terms and the best documents that a task has found."""

    def __init__(self, queries: list[tuple[int | None, np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
        """queries: item_id, terms and how often each term is in the item."""
        self.queries, self.weight, self.n_docs, self.n_terms, self.k = queries, weight, n_docs, n_terms, k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]

    def impacts(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 75 + 25 * length * self.n_docs // self.n_terms
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))

    def run(self, ids: list[int | None], lengths: np.ndarray, per: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """A run of documents: doc_id, all terms and terms of queries of each, then the postings, document after document."""
        keys = [(d is None, d or 0) for d in ids]
        order = sorted(range(len(ids)), key=keys.__getitem__)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        of = np.repeat(np.arange(len(ids)), per)
        impact = self.impacts(term, tf, lengths[of])
        some = impact > 0
        treaps = Treaps(term[some], rank[of[some]], impact[some], len(self.weight))
        sorted_keys = [keys[i] for i in order]
        for q, (_, terms, times) in enumerate(self.queries):
            best = self.best[q]
            least, least_doc = 0, -1.0
            if len(best) == self.k:
                least = -best[-1][0]
                least_doc = bisect_left(sorted_keys, best[-1][1:])  # with equal scores only documents before it can still enter
            scores, docs = treaps.search(terms, times, len(ids), self.k, least, least_doc)
            found = [(-int(s), *sorted_keys[d]) for s, d in zip(scores, docs, strict=True) if s > 0]
            self.best[q] = sorted(best + found)[: self.k]

    def rows(self) -> pa.RecordBatch:
        flat = [(q, self.queries[q][0], None if null else d, -s) for q, best in enumerate(self.best) for s, null, d in best]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(4)], ["query", "item_id", "doc_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], searcher: Searcher, shard: int, postings: int) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, n, ids, tfs) to the best documents of each query."""
    held: list[pa.RecordBatch] = []
    docs = terms = 0

    def run() -> None:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: t[name].combine_chunks() if t[name].num_chunks != 1 else t[name].chunk(0)
        ids, tfs = column("ids"), column("tfs")
        searcher.run(column("doc_id").to_pylist(), column("n").to_numpy(), ids.value_lengths().to_numpy(), ids.flatten().to_numpy(), tfs.flatten().to_numpy())

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        docs, terms = docs + b.num_rows, terms + len(b["ids"].flatten())
        if docs >= shard or terms >= postings:
            run()
            held, docs, terms = [], 0, 0
    if held:
        run()
    yield searcher.rows()


def _blocks(items: DataFrame, block_terms: int) -> tuple[DataFrame, int]:
    """items (item_id, text) with a number and its block, so that a block has some block_terms terms; staged."""
    sizes = items.select("item_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.xxhash64("item_id", "text").alias("mix"))
    rows = staged(sizes, "search_items")
    chars = rows.agg(F.sum("chars")).first()[0] or 0
    return rows, max(1, ceil(chars / 2 / block_terms))


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, shard: int = SHARD, postings: int = POSTINGS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) to item_id, rank, doc_id and score of each item's best k documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, n = _blocks(items.select("item_id", "text"), block_terms)
    out = [_search_block(docs, rows.filter(F.pmod("mix", F.lit(n)) == b), k, shard, postings) for b in range(n)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search_block(docs: DataFrame, items: DataFrame, k: int, shard: int, postings: int) -> DataFrame:
    spark = docs.sparkSession
    queries = [(r.item_id, Counter(terms_of(r.text))) for r in items.orderBy(F.col("item_id").asc_nulls_last(), "text").collect()]  # one block, bounded
    words = sorted(set().union(*[c for _, c in queries]))
    vocabulary = {w: i for i, w in enumerate(words)}
    lists = docs.select("doc_id", counted_column("text", vocabulary).alias("t")).filter("t.n > 0").select("doc_id", "t.*")
    lists = staged(lists, "search_lists")
    totals = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(len(words), np.int64)
    for r in lists.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow().to_batches():  # a row for each term of the block
        df[r.column(0).to_numpy()] = r.column(1).to_numpy()
    weight = np.floor(1000 * np.log((2 * totals.n + 2) / (2 * df + 1))).astype(np.int64)
    asked = [(i, np.array([vocabulary[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for i, c in queries]
    n_docs, n_terms = totals.n, max(totals.l, 1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(batches, Searcher(asked, weight, n_docs, n_terms, k), shard, postings)

    found = lists.filter(F.size("ids") > 0).mapInArrow(best, "query long, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    top = staged(top.select("item_id", "rank", "doc_id", "score"), "search_top")
    dropped(lists)
    return top


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_id, doc_id, len(x) AS n, x FROM t WHERE len(x) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(x) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs),
m AS (SELECT row_id, doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM d, g),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, row_id, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row_id) GROUP BY item_id, row_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
