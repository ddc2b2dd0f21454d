"""Filters, sort orders and pages of listings."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 24


def item_filter(q: str | None = None, category: str | None = None, tag: str | None = None) -> Column:
    """Title or uploader holds ``q`` (its % and _ match anything), the category is equal, a tag is there.

    What is None or empty isn't asked for.
    """
    asked = []
    if q:
        asked.append(F.col("title").ilike(f"%{q}%") | F.col("uploader").ilike(f"%{q}%"))
    if category:
        asked.append(F.col("category") == category)
    if tag:
        asked.append(F.array_contains("tags", tag))
    return reduce(Column.__and__, asked, F.lit(True))


def named_like(name: str, q: str | None = None, tag: str | None = None) -> Column:
    """Name holds ``q`` and the tags hold ``tag``, each if asked for."""
    by_name = F.col(name).ilike(f"%{q}%") if q else F.lit(True)
    return by_name & (F.array_contains("tags", tag) if tag else F.lit(True))


def holds_all(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def due(when: Column, as_of: Column) -> Column:
    """It has a time and that has come."""
    return when.isNotNull() & (when <= as_of)


ITEM_ORDERS = {
    "newest": ["added_at", "desc"],
    "oldest": ["added_at", "asc"],
    "largest": ["size_bytes", "desc"],
    "seeders": ["seeders", "desc"],
    "downloads": ["downloads", "desc"],
}
#: By entity, the default first.
CATALOGUE_ORDERS = {
    "works": {
        "popular": ["popularity", "desc", "date", "desc", "title", "asc"],
        "newest": ["date", "desc", "title", "asc"],
        "oldest": ["date", "asc", "title", "asc"],
    },
    "sites": {
        "name": ["name", "asc"],
        "name_desc": ["name", "desc"],
        "works": ["related_count", "desc", "name", "asc"],
        "network": ["secondary", "asc", "name", "asc"],
    },
    "networks": {
        "name": ["name", "asc"],
        "name_desc": ["name", "desc"],
        "sites": ["related_count", "desc", "name", "asc"],
    },
    "people": {
        "name": ["name", "asc"],
        "name_desc": ["name", "desc"],
        "works": ["related_count", "desc", "name", "asc"],
        "newest": ["date", "desc", "name", "asc"],
        "oldest": ["date", "asc", "name", "asc"],
    },
}


def sort_columns(orders: dict[str, list[str]], key: str | None, tie: str) -> list[Column]:
    """Columns of a named order, nulls last, ending with the primary key; the first order if the name is unknown."""
    spec = orders.get(key or "", next(iter(orders.values())))
    out = [getattr(F.col(c), f"{d}_nulls_last")() for c, d in zip(spec[::2], spec[1::2])]
    return [*out, F.col(tie).asc()]


@dataclass(frozen=True)
class PageInfo:
    """Where a page of a listing lies."""

    page: int
    total: int
    size: int = PAGE_SIZE

    @classmethod
    def of(cls, page: str | int | None, total: int, size: int = PAGE_SIZE) -> "PageInfo":
        """Bad and small page numbers are the first page, those beyond the end the last one."""
        try:
            number = int(page or 1)
        except ValueError:
            number = 1
        return cls(min(max(1, number), max(1, math.ceil(total / size))), total, size)

    @classmethod
    def at(cls, page: str | int | None, total: int, size: int = PAGE_SIZE) -> "PageInfo":
        """Like ``of``, but a page beyond the end stays, and is empty."""
        try:
            return cls(max(1, int(page or 1)), total, size)
        except ValueError:
            return cls(1, total, size)

    @property
    def pages(self) -> int:
        return max(1, math.ceil(self.total / self.size))

    @property
    def start(self) -> int:
        return (self.page - 1) * self.size + 1 if self.total else 0

    @property
    def end(self) -> int:
        return min(self.page * self.size, self.total)

    def url(self, path: str, **params) -> str:
        """A link to this page; parameters that are None or empty are left out."""
        kept = {k: v for k, v in {**params, "page": self.page}.items() if v}
        return f"{path}?{urlencode(kept)}" if kept else path


def page_of(rows: DataFrame, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page; Spark plans it as a top-k with offset, not as a full sort."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
