"""SentencePiece encoding and decoding with a distinct-chunk table.

A chunk is a run of white space markers with what follows up to the next marker. No piece of the model has a marker
after another character (checked when the model is loaded), so no merge crosses the start of a chunk, and a text's ids
are its chunks' ids in order. A table holds each distinct chunk once: its ids, and what the library's decode makes of
these ids behind other text. Texts are joined back from the table by position, ids and decoded bytes alike; of a whole
text decode drops the first space. Byte pieces never cross a chunk, as a chunk starts with a piece that has a marker.

A table belongs to a Python worker, is filled from the batches it sees and is dropped at TABLE entries, so memory is
bounded and no result depends on it.

Nulls count as empty texts (begin and end ids only). A null doc_id is reported as null. Repeated rows give repeated
results; very long texts are read whole. Further columns pass through encoded() in a struct, so that no name clashes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, table, whole

MARK = "▁"
#: Chunks that a worker's table holds.
TABLE = 120_000
#: Characters of texts whose chunks are looked up together, and texts taken out of an Arrow batch at a time.
PORTION = 1 << 18
TEXTS = 128


class PieceCoder:
    """Encodes and decodes like the library, with begin and end ids."""

    def __init__(self, model: str, limit: int = TABLE) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.limit = limit
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: Whether chunks are apart: else whole texts go through the library.
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and self._plain()
        self.mark = self.sp.piece_to_id(MARK)
        #: Ids of a text that stands before a chunk when it is decoded, and its length.
        self.lead = self.sp.encode("a")
        self.lead_chars = len(self.sp.decode(self.lead))
        #: What the library decodes each id to behind other text; ids whose text depends on their neighbours (bytes) have none.
        self.joins = np.array([not (self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_control(i)) for i in range(len(pieces))])
        self.surface = [self._behind([i]) if j else b"" for i, j in enumerate(self.joins)]
        self.surface_bytes = np.array([len(x) for x in self.surface], np.int64)
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self._empty()

    def _plain(self) -> bool:
        """No normalisation but a marker in front and markers for spaces."""
        probe = "  a\tb  Åﬁ c "
        return self.sp.decode(self.sp.encode(probe)) == probe

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(self.limit, np.int64)
        self.lens = np.zeros(self.limit, np.int64)
        self.decoded: list[bytes] = []

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and how many each has."""
        plain = [c for c in chunks if c and c[0] != " "]
        # One marker each, so one id that starts with it: the library segments them as one text.
        ids = np.array(self.sp.encode(" ".join(plain)), np.uint32)
        lens = dict(zip(plain, np.diff(np.append(np.flatnonzero(self.marked[ids]), len(ids))).tolist(), strict=True))
        others = [c for c in chunks if not c or c[0] == " "]
        more = dict(zip(others, (self.sp.encode(c) if c else [self.mark] for c in others), strict=True))
        chunks[:] = plain + others
        tail = np.fromiter(chain.from_iterable(more[c] for c in others), np.uint32)
        return np.concatenate([ids, tail]), np.array([lens[c] for c in plain] + [len(more[c]) for c in others], np.int64)

    def _add(self, chunks: list[str]) -> None:
        flat, lens = self._segment(chunks)
        k, n, total = len(self.at), len(chunks), len(flat)
        while k + n > len(self.starts):  # some texts have more chunks than a table
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + total] = flat
        ends = np.cumsum(lens)
        self.starts[k : k + n] = self.used + ends - lens
        self.lens[k : k + n] = lens
        self.used += total
        self.decoded += self._decode_chunks(flat, lens)
        self.at.update(zip(chunks, range(k, k + n), strict=True))

    def _behind(self, ids: list[int]) -> bytes:
        """The library's decode of ids behind other text, in UTF-8."""
        return self.sp.decode(self.lead + ids)[self.lead_chars :].encode()

    def _decode_chunks(self, flat: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """What each chunk's ids decode to behind other text. Chunks with byte pieces go through the library whole."""
        all_ = b"".join(map(self.surface.__getitem__, flat.tolist()))
        stops = np.cumsum(lens)
        ends = np.concatenate([[0], np.cumsum(self.surface_bytes[flat])])[np.concatenate([[0], stops])].tolist()
        out = [all_[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for k in np.unique(np.searchsorted(stops, np.flatnonzero(~self.joins[flat]), side="right")).tolist():
            out[k] = self._behind(flat[stops[k] - lens[k] : stops[k]].tolist())
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Library inputs of a text's chunks: the marker in front of each is left out; further ones are spaces."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        out.append(" " * spaces + parts[-1])
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """All ids of each text, and what they decode to, in UTF-8. Texts go in portions of PORTION characters."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= PORTION):
                chars += len(texts[to] or "")
                to += 1
            yield from self._portion(texts[at:to])
            at = to

    def _portion(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        ends = self.sp.bos_id(), self.sp.eos_id()
        if not self.apart:
            for t in texts:
                ids = np.array([ends[0], *self.sp.encode(t or ""), ends[1]], "<u4")
                yield ids, self.decode(ids).encode()
            return
        spelled = [(t or "").replace(MARK, " ") for t in texts]
        split = [self.chunks(t) if t else [] for t in spelled]
        new = set().union(*split).difference(self.at)
        if new:
            if len(self.at) + len(new) > self.limit and self.at:
                self._empty()
                new = set().union(*split)
            self._add(list(new))
        for chunks in split:
            rows = list(map(self.at.__getitem__, chunks))
            idx = np.array(rows, np.int64)
            lens = self.lens[idx]
            stop = np.cumsum(lens)
            pos = np.repeat(self.starts[idx] - (stop - lens), lens) + np.arange(stop[-1] if len(stop) else 0)
            ids = np.empty(len(pos) + 2, "<u4")
            ids[0], ids[-1] = ends
            ids[1:-1] = self.flat[pos]
            yield ids, b"".join(map(self.decoded.__getitem__, rows)).removeprefix(b" ")

    def encode(self, text: str | None) -> tuple[np.ndarray, bytes]:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


def _slices(batch: pa.Array) -> Iterator[list]:
    """A batch as Python values, a few rows at a time."""
    for at in range(0, len(batch), TEXTS):
        yield batch.slice(at, TEXTS).to_pylist()


_coders: dict[str, PieceCoder] = {}


def coder(model: str) -> PieceCoder:
    if model not in _coders:
        _coders[model] = PieceCoder(model)
    return _coders[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests_column(text: str = "text", model: str | None = None, ids: bool = False) -> Column:
    """n_tokens, ids_sha256, decoded_sha256, and with ids the ids too. model: a file that every worker has; by default the public one."""
    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>>" if ids else ">")

    def digests(text: pa.Array) -> pa.Array:
        c = coder(model or default_model())
        n, ids_sha, decoded_sha, lists = [], [], [], []
        for texts in _slices(text):
            found = []
            for own, decoded in c.encode_all(texts):
                n.append(len(own))
                ids_sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    found.append(own.view(np.int32))
            if ids:
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))))
        columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
        if ids:
            columns["ids"] = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return F.arrow_udf(digests, kind)(F.col(text).cast("string"))


def ids_column(text: str = "text", model: str | None = None) -> Column:
    """The ids themselves."""

    def ids(text: pa.Array) -> pa.Array:
        c = coder(model or default_model())
        return pa.array([x.view(np.int32) for texts in _slices(text) for x, _ in c.encode_all(texts)], pa.list_(pa.int32()))

    return F.arrow_udf(ids, "array<int>")(F.col(text).cast("string"))


def decoded_column(ids: str = "ids", model: str | None = None) -> Column:
    def decoded(ids: pa.Array) -> pa.Array:
        c = coder(model or default_model())
        return pa.array([None if x is None else c.sp.decode(x) for x in ids.to_pylist()], pa.string())

    return F.arrow_udf(decoded, "string")(F.col(ids))


def encoded(docs: DataFrame, text: str = "text", model: str | None = None, ids: bool = False) -> DataFrame:
    """_doc (docs' columns, whatever their names) and tokens: n_tokens, the digests of ids and of the decoded text, and with ids the ids."""
    bounded_batches(docs.sparkSession)
    return docs.select(whole(docs), digests_column(text, model, ids).alias("tokens"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs).select("_doc.doc_id", "tokens.*")
