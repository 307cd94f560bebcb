"""The state of a stream is used only for documents whose pages come in several batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Row

from quire.streaming import pages


class State(dict):
    """A map, a value and timers in place of the executor's, which counts what is asked of it."""

    def __init__(self):
        super().__init__()
        self.calls, self.timers = [], []

    def __getattribute__(self, name):
        if name in ("iterator", "keys", "updateValue", "clear", "exists", "update", "registerTimer", "deleteTimer", "listTimers", "containsKey"):
            object.__getattribute__(self, "calls").append(name)
        return object.__getattribute__(self, name)

    iterator = lambda self: iter([(k, v) for k, v in self.items()])
    keys = lambda self: iter(list(dict.keys(self)))
    updateValue = dict.__setitem__
    update = lambda self, v: self.__setitem__("closed", v)
    exists = lambda self: "closed" in self
    registerTimer = lambda self, at: self.timers.append(at)
    deleteTimer = lambda self, at: self.timers.remove(at)
    listTimers = lambda self: iter(self.timers)


def test_a_document_in_one_batch_is_not_held():
    p = pages.PageCollector(60_000)
    p.handle, p.pages, p.closed = State(), State(), State()
    row = lambda page, total=3: Row(doc_id=1, page_number=page, total=total, content=f"p{page}", arrived_at=dt.datetime(2024, 1, 1, 0, page))
    got = list(p.handleInputRows((1,), iter([row(3), row(1), row(2), row(1)]), None))
    assert [(r.kind, r.n_pages, r.pages) for r in got] == [("document", 3, ["p1", "p2", "p3"])]
    assert p.pages.calls == ["keys"] and p.closed.calls == ["exists", "update"] and p.handle.calls == ["registerTimer"]
    # In two batches: what is held comes back, and its timer gives way to the one that forgets the document.
    p.handle, p.pages, p.closed = State(), State(), State()
    assert list(p.handleInputRows((2,), iter([row(2)]), None)) == [] and len(p.handle.timers) == 1 and len(p.pages) == 1
    got = list(p.handleInputRows((2,), iter([row(1), row(3)]), None))
    assert got[0].pages == ["p1", "p2", "p3"] and len(p.handle.timers) == 1 and not p.pages
