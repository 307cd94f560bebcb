"""Page ranges as expressions: two dialects over '1,3-5' and a page count.

A third one counts from 0 ('0,2-5,10') and belongs to the foreign converter, which gets the text as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(spec: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _between(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _ends(part: Column) -> tuple[Column, Column]:
    at = F.instr(part, "-")
    return F.substring_index(part, "-", 1).try_cast("int"), F.substring(part, at + 1, F.length(part)).try_cast("int")


def _everything(total: Column) -> Column:
    return _between(F.lit(1), total)


def clipped_pages(spec: Column, total: Column) -> Column:
    """Ranges are clipped to the document, bad parts ignored; nothing left means all pages."""

    def one(p: Column) -> Column:
        a, b = _ends(p)
        span = F.when(a.isNotNull() & b.isNotNull(), _between(F.greatest(a, F.lit(1)), F.least(b, total)))
        page = p.try_cast("int")
        single = F.when((page >= 1) & (page <= total), F.array(page))
        return F.coalesce(F.when(F.contains(p, F.lit("-")), span).otherwise(single), F.array().cast("array<int>"))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(_parts(spec), one))))
    return F.when(F.size(found) > 0, found).otherwise(_everything(total))


def whole_range_pages(spec: Column, total: Column, fallback: int = 5) -> Column:
    """Ranges count only if wholly inside; a text that gives nothing means the first pages, a blank one all."""

    def one(p: Column) -> Column:
        a, b = _ends(p)
        span = F.when((a >= 1) & (b <= total) & (a <= b), F.sequence(a, F.greatest(a, b)))
        page = p.try_cast("int")
        single = F.when((page >= 1) & (page <= total), F.array(page))
        return F.coalesce(F.when(F.contains(p, F.lit("-")), span).otherwise(single), F.array().cast("array<int>"))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(_parts(spec), one))))
    blank = F.regexp_replace(F.coalesce(spec, F.lit("")), r"\s+", "") == ""
    return F.when(blank, _everything(total)).when(F.size(found) > 0, found).otherwise(_between(F.lit(1), F.least(total, F.lit(fallback))))
