"""What a reader of the catalogue asks for: listings by page, tags, and single entities with all that belongs to them.

Requests take raw values, as they come from a query string: blanks aren't asked for, unknown sort names are
the default, bad page numbers the first page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodeworks.functions.text import json_list
from lodeworks.operators import catalogue, selection
from lodeworks.operators.catalogue import Detail
from lodeworks.operators.selection import PageInfo


class NotFound(LookupError):
    """There is no such entity, or what names it is no key of that kind."""


@dataclass(frozen=True)
class Listing:
    """A page of records, how many there are of the kind asked for and of items in all, and facets over all rows."""

    records: DataFrame
    page: PageInfo
    total: int
    total_all: int
    facets: dict[str, DataFrame]


ITEM_COLUMNS = ["item_id", "title", "category", "size_bytes", "added_at", "seeders", "leechers", "uploader", "downloads", "tags", "image_url", "magnet"]
KEYS = {"works": "work_id", "sites": "site_id", "networks": "network_id", "people": "person_id"}


class Catalogue:
    """Reads the tables of ``roles``: works, sites, networks, people, bridge, items, listed_items, attempts and peers."""

    def __init__(self, roles):
        self.roles = roles

    def _asked(self, entity: str, q: str | None, tag: str | None):
        name = "title" if entity == "works" else "name"
        return selection.named_like(name, (q or "").strip() or None, (tag or "").strip() or None if entity == "works" else None)

    def cards(self, entity: str, q: str | None = None, tag: str | None = None) -> DataFrame:
        """Cards of all entities that are asked for."""
        r = self.roles
        rows = self._rows(entity).where(self._asked(entity, q, tag))
        if entity == "works":
            return catalogue.work_cards(rows, r.sites, r.bridge, r.attempts, r.peers)
        if entity == "sites":
            rows = rows.join(r.networks.select("network_id", F.col("name").alias("network_name")), "network_id", "left")
            return catalogue.related_cards(entity, rows, "site_id", r.works, "work_id", F.col("network_name"))
        if entity == "networks":
            return catalogue.related_cards(entity, rows, "network_id", r.sites, "site_id")
        return catalogue.related_cards(entity, rows, "person_id", r.bridge, "work_id", F.col("nationality"), F.col("date"))

    def _rows(self, entity: str) -> DataFrame:
        if entity not in KEYS:
            raise NotFound(entity)
        return getattr(self.roles, entity)

    def list_entities(self, entity: str, q: str | None = None, tag: str | None = None, sort: str | None = None, page: str | int | None = None) -> Listing:
        """A page of works, sites, networks or people; works can be asked for by tag and come with the 16 most frequent tags."""
        total = self._rows(entity).where(self._asked(entity, q, tag)).count()
        info = PageInfo.at(page, total)
        order = selection.sort_columns(selection.CATALOGUE_ORDERS[entity], sort, "id")
        records = selection.page_of(self.cards(entity, q, tag), order, info.page)
        facets = {"tags": catalogue.tag_facets(self.roles.works, nonblank=True, limit=16)} if entity == "works" else {}
        return Listing(records, info, total, self.roles.items.count(), facets)

    def list_items(self, q: str | None = None, category: str | None = None, tag: str | None = None, sort: str | None = None, page: str | int | None = None) -> Listing:
        """A page of items, with all categories and the 30 most frequent tags."""
        asked = selection.item_filter((q or "").strip() or None, category, tag)
        items = self.roles.items
        total = items.where(asked).count()
        info = PageInfo.at(page, total)
        rows = self.roles.listed_items.where(asked).select(*ITEM_COLUMNS)
        records = selection.page_of(rows, selection.sort_columns(selection.ITEM_ORDERS, sort, "item_id"), info.page)
        return Listing(records, info, total, items.count(), {"categories": catalogue.category_facets(items), "tags": catalogue.tag_facets(items, limit=30)})

    def all_tags(self) -> DataFrame:
        """Every tag of items and how often it occurs."""
        return catalogue.tag_facets(self.roles.items)

    def _key(self, rows: DataFrame, column: str, text):
        """A key as the column holds it: canonical UUIDs in text columns, integers in others."""
        if isinstance(rows.schema[column].dataType, StringType):
            import uuid

            try:
                return str(uuid.UUID(str(text)))
            except ValueError:
                raise NotFound(f"{column} {text!r}") from None
        try:
            return int(text)
        except (TypeError, ValueError):
            raise NotFound(f"{column} {text!r}") from None

    def get_item(self, item_id) -> DataFrame:
        """The item's one row, with the work that it is matched to; lists kept as JSON are read."""
        r = self.roles
        key = self._key(r.items, "item_id", item_id)
        rows = r.items.where(F.col("item_id") == key)
        if not rows.limit(1).count():
            raise NotFound(f"item_id {key}")
        for name in ("files",):
            if name in rows.columns and isinstance(rows.schema[name].dataType, StringType):
                rows = rows.withColumn(name, json_list(F.col(name)))
        return catalogue.item_detail(rows, r.attempts.where(F.col("item_id") == key), r.works, r.sites)

    def get_entity(self, entity: str, entity_id) -> Detail:
        """A work, site, network or person, and what belongs to it."""
        r = self.roles
        key = self._key(self._rows(entity), KEYS[entity], entity_id)
        try:
            if entity == "works":
                return catalogue.work_detail(key, r.works, r.sites, r.networks, r.people, r.bridge, r.items, r.attempts)
            if entity == "sites":
                return catalogue.site_detail(key, r.sites, r.networks, r.works)
            if entity == "networks":
                return catalogue.network_detail(key, r.networks, r.sites, r.works)
            return catalogue.person_detail(key, r.people, r.bridge, r.works)
        except KeyError as e:
            raise NotFound(str(e)) from None
