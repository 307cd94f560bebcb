"""Language identification by bit-sliced Bloom filters of n-grams.

A language's n-grams are those of 2 to 4 characters that SHARE of its training documents or more hold (letters in
lower case; a run of anything else is one boundary, which may begin or end an n-gram but not stand inside it). All
languages share one table of rows with a bit per language: an n-gram sets its language's bit in HASHES rows, and the
AND of its rows returns all languages that hold it at once. A text is looked up n-gram by n-gram; the bits are counted per
language, and a language whose bits turn up falsely with rate f (its fill to the power of HASHES) has its count c of n
corrected to (c - n f) / (1 - f). The greatest corrected count decides; its share of all is the score.

Training reads TRAIN_DOCS documents of a language at most (by hash of doc_id, all if there are fewer), and their whole
texts. SHARE bounds the n-grams of a language by the mean number of distinct n-grams of a document over SHARE, so the
model does not grow with the corpus; it grows with the number of languages. Every document is scored with its whole
text, in pieces of about PIECE characters that end where no n-gram is cut.

Nulls: a null text, and one without a letter, is `und` with score 0; a null lang trains nothing; a null doc_id has ''
for its text. A text with letters but no known n-gram gets the language with most training documents, with score 0, as
ties go to the language with more of them, then to the first by code point. Without any training row all are `und`.
Repeated rows get equal results. An empty table gives no rows. Further columns pass through predicted() in a struct, so
that no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, small, staged, table, whole

ORDERS = (2, 3, 4)
SHARE = 0.03
TRAIN_DOCS = 2000
HASHES = 3
#: Rows of the table for each n-gram of the language with most, before rounding up to a power of two.
ROWS = 10
FOLDS, HELD = 3, 1
UNKNOWN = "und"
PIECE = 1 << 20
PORTION = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end before a character that is no letter."""
    at = 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to].isalpha():
            to += 1
        yield text[at:to]
        at = to


def ngrams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Letters of each text, and for each order the hashes of all its n-grams and the text of each."""
    low = [t.lower() + "\0" for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letters()[points]
    n_letters = np.bincount(of[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stands for it
    points = np.concatenate([[0], np.where(letter, points, 0)[keep]]).astype(np.uint64)
    of = np.concatenate([[0], of[keep]])
    out = []
    with np.errstate(over="ignore"):
        h, whole_ = points, np.ones(len(points), bool)
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * _BASE + points[n - 1 :] + np.uint64(n)
            whole_ = whole_[:-1] & (points[n - 2 : -1] != 0) if n > 2 else np.ones(len(h), bool)
            if n in ORDERS:
                g = h[whole_]
                g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                # The second character of an n-gram is a letter of its text, or the boundary that ends it there.
                out.append((g ^ (g >> np.uint64(29)), of[1 : len(h) + 1][whole_]))
    return n_letters, out


class LanguageFilter:
    """Rows of bits, one bit for each language."""

    def __init__(self, grams: list[np.ndarray]) -> None:
        """grams: hashes of the n-grams of each language."""
        self.n = len(grams)
        most = max([1, *map(len, grams)])
        self.size = 1 << (ROWS * most - 1).bit_length()
        self.rows = np.zeros((self.size, -(-self.n // 64)), np.uint64)
        filled = np.zeros(self.n)
        for i, g in enumerate(grams):
            at = np.unique(np.concatenate([self._at(g, k) for k in range(HASHES)]))
            self.rows[at, i // 64] |= np.uint64(1 << (i % 64))
            filled[i] = len(at) / self.size
        self.false_rate = filled**HASHES

    def _at(self, g: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g + np.uint64(k) * ((g >> np.uint64(32)) | np.uint64(1))) & np.uint64(self.size - 1)).astype(np.int64)

    def languages(self, g: np.ndarray) -> np.ndarray:
        """Of each n-gram the bits of the languages that hold it, falsely or not."""
        out = self.rows[self._at(g, 0)]
        for k in range(1, HASHES):
            out &= self.rows[self._at(g, k)]
        return out

    def counts(self, g: np.ndarray, of: np.ndarray, n_texts: int) -> np.ndarray:
        """How often each language holds an n-gram of each text. of: the text of each n-gram, ascending."""
        found = self.languages(g)
        ends = np.searchsorted(of, np.arange(n_texts + 1))
        out = np.empty((n_texts, self.n), np.int64)
        for i in range(self.n):
            bit = ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            out[:, i] = np.diff(np.concatenate([[0], np.cumsum(bit)])[ends])
        return out

    def corrected(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (counts - n[:, None] * self.false_rate) / (1 - self.false_rate))


class LanguageModel:
    def __init__(self, languages: list[str], grams: list[np.ndarray]) -> None:
        """languages: those with most training documents first; grams: hashes of the n-grams of each."""
        self.languages, self.filter = languages, LanguageFilter(grams)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        of, parts = [], []
        n = np.zeros(len(texts), np.int64)
        counts = np.zeros((len(texts), max(1, len(self.languages))), np.int64)
        letters = np.zeros(len(texts), np.int64)

        def count() -> None:
            some, found = ngrams(parts)
            np.add.at(letters, of, some)
            for g, at in found if self.languages else []:
                np.add.at(counts, of, self.filter.counts(g, at, len(parts)))
                np.add.at(n, of, np.bincount(at, minlength=len(parts)))
            of.clear()
            parts.clear()

        held = 0
        for i, t in enumerate(texts):
            for p in pieces(t or ""):
                of.append(i)
                parts.append(p)
                held += len(p)
                if held >= PORTION:
                    count()
                    held = 0
        if parts:
            count()
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        held_by = self.filter.corrected(counts, n)
        best, total = held_by.argmax(1), held_by.sum(1)
        score = np.where(total > 0, held_by.max(1) / np.where(total > 0, total, 1), 0.0)
        return [(self.languages[b], float(s)) if k else (UNKNOWN, 0.0) for b, s, k in zip(best, score, letters, strict=True)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, text) to how many documents of a batch hold each n-gram, by language."""
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(0).dictionary_encode()
        lang, names = code.indices.to_numpy(), code.dictionary
        found: list[list[np.ndarray]] = [[] for _ in names]
        for i, t in zip(lang, b.column(1), strict=True):
            parts = [g for p in pieces(t.as_py()) for g, _ in ngrams([p])[1]]
            if parts:
                found[i].append(np.unique(np.concatenate(parts)))
        for i, grams in enumerate(found):
            if grams:
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(names[i], len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def train(docs: DataFrame, most: int = TRAIN_DOCS, share: float = SHARE) -> LanguageModel:
    """docs (doc_id, text, lang), without those held out, to the model."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = staged(rows.groupBy("lang").count(), "lang_sizes")
    rate = small(sizes.select(F.col("lang").alias("r_lang"), (F.lit(float(most)) / F.col("count")).alias("rate")), sizes)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30) < F.col("rate")
    sample = rows.join(rate, rows["lang"] == rate["r_lang"]).filter(drawn).select("lang", "text")
    counted = staged(sample.mapInArrow(lambda it: _with_sizes(it), "lang string, gram long, n long"), "lang_grams")
    per = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A row without gram holds the number of a language's documents.
    total = per.filter("gram IS NULL").select(F.col("lang").alias("t_lang"), F.col("n").alias("docs"))
    common = per.filter("gram IS NOT NULL").join(small(staged(total, "lang_docs")), F.col("lang") == F.col("t_lang")).filter(F.col("n") >= F.col("docs") * share)
    order = [r.lang for r in sizes.orderBy(F.col("count").desc(), "lang").collect()]  # a row for each language
    found = common.select("lang", "gram").toArrow()
    at = {lang: i for i, lang in enumerate(order)}
    code = found["lang"].combine_chunks().dictionary_encode()
    of = np.array([at[x] for x in code.dictionary.to_pylist()], np.int64)[code.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
    gram = found["gram"].to_numpy().view(np.uint64)
    return LanguageModel(order, [gram[of == i] for i in range(len(order))])


def _with_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_document_frequencies, and a row without gram for the number of documents of each language of a batch."""
    for b in batches:
        yield from _document_frequencies(iter([b]))
        if b.num_rows:
            counts = b.column(0).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), pa.nulls(len(counts), pa.int64()), counts.field("counts")], ["lang", "gram", "n"])


def predicted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """_doc (docs' columns) and language: lang_pred and score."""
    bounded_batches(docs.sparkSession)

    def predict(text: pa.Array) -> pa.Array:
        found = model.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    return docs.select(whole(docs), F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(F.col(text).cast("string")).alias("language"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return predicted(docs.select("doc_id", "text"), model).select("_doc.doc_id", held_out("_doc.doc_id").alias("held_out"), "language.*")
