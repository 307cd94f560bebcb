"""Nodes of nested JSON, all levels, from one pass over each document.

A document is read once, whatever its depth, in the task that holds it; every node comes out as a row with its path and
its own JSON, without the list of the nodes below it, so no byte is parsed again for each level and no job runs while
a plan is made. Memory is one document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.staging import bounded_batches

NODES = pa.schema([("doc_id", pa.int64()), ("path", pa.list_(pa.int32())), ("node", pa.string())])
#: Rows that go to Spark together, and lists and objects in one another beyond which a document counts as broken.
ROWS = 4096
DEPTH = 1000


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key comes twice")
    return found


def _finite(text: str) -> float:
    number = float(text) + 0.0  # no negative zero, as in a variant
    if number in (float("inf"), float("-inf")):
        raise ValueError(f"{text} is too large")
    return number


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


_decode = json.JSONDecoder(object_pairs_hook=_unique, parse_float=_finite, parse_constant=_no_constant).decode
_encode = json.JSONEncoder(ensure_ascii=False).encode
_BROKEN = object()


def _walk(text: str | None, lists: tuple[str, ...]) -> Iterator[tuple[list[int], object]]:
    """(path, node) as in walk, but nodes are decoded, and a broken document is _BROKEN."""
    try:
        root = _decode(text or "")
    except (ValueError, RecursionError):
        yield [], _BROKEN
        return
    stack = [([], root)]
    while stack:
        path, node = stack.pop()
        key, kids = lists[min(len(path), len(lists) - 1)], None
        if isinstance(node, dict) and isinstance(node.get(key), list):
            kids = node.pop(key)
        yield path, node
        if kids and len(path) < DEPTH // 2:
            stack += [([*path, i], kids[i]) for i in range(len(kids) - 1, -1, -1)]


def walk(text: str | None, lists: tuple[str, ...]) -> Iterator[tuple[list[int], str | None]]:
    """(path, node) of each node in depth-first order, the document itself first; a broken document is one node without JSON.

    lists: the key of the list below a node of each level; the last holds for all deeper ones.
    """
    for path, node in _walk(text, lists):
        yield path, None if node is _BROKEN else _encode(node)


def _is(value: object, t: pa.DataType) -> bool:
    """Whether a column of t has the value as a variant is cast to t: texts, or lists of numbers that a double holds."""
    if value is None:
        return True
    if t == pa.string():
        return type(value) is str
    return type(value) is list and all(type(n) is float or type(n) is int and abs(n) < 1 << 53 for n in value)


def _all_are(values: list[object], t: pa.DataType) -> bool:
    """Whether _is holds for all values; for most columns without a look at each."""
    kinds = set(map(type, values)) - {type(None)}
    return kinds <= {str} if t == pa.string() else all(_is(v, t) for v in values if v is not None)


def _columns(found: list[object], fields: list[pa.Field]) -> list[pa.Array]:
    """node and the fields of the nodes: JSON of those that have other values than the fields' types, else the values."""
    objects = [x if type(x) is dict else {} for x in found]
    columns = [[x.get(f.name) for x in objects] for f in fields]
    if fields and all(_all_are(c, f.type) for c, f in zip(columns, fields, strict=True)):
        return [pa.nulls(len(found), pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]]
    fits = [all(_is(v, f.type) for v, f in zip(row, fields, strict=True)) for row in zip(*columns, strict=True)] if fields else [False] * len(found)
    node = [None if fit or x is _BROKEN else _encode(x) for x, fit in zip(found, fits, strict=True)]
    return [pa.array(node, pa.string()), *[pa.array([v if fit else None for v, fit in zip(c, fits, strict=True)], f.type) for c, f in zip(columns, fields, strict=True)]]


def nodes(files: DataFrame, lists: tuple[str, ...], texts: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """files (doc_id, json) to doc_id, path and node: all nodes below the documents, and the documents themselves (path []).

    texts, numbers: keys that are columns too, of text and of lists of double. A node whose values of these keys are such,
    null or missing has them there, and its JSON is not written; another node has its JSON only.
    """
    fields = [*[pa.field(k, pa.string()) for k in texts], *[pa.field(k, pa.list_(pa.float64())) for k in numbers]]
    schema = pa.schema([*NODES, *fields])

    def batch(ids: list, paths: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int32())), *_columns(found, fields)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, paths, found = [], [], []
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                at = doc_id.as_py()
                for path, node in _walk(text.as_py(), lists):
                    ids.append(at)
                    paths.append(path)
                    found.append(node)
                    if len(ids) >= ROWS:
                        yield batch(ids, paths, found)
                        ids, paths, found = [], [], []
        if ids:
            yield batch(ids, paths, found)

    bounded_batches(files.sparkSession)
    more = [*[f"`{k}` string" for k in texts], *[f"`{k}` array<double>" for k in numbers]]
    return files.select("doc_id", "json").mapInArrow(rows, ", ".join(["doc_id long, path array<int>, node string", *more]))
