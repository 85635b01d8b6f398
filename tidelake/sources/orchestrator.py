"""Cache-or-fetch of named sources: tables keyed by what they hold, refreshed when asked, with a table of metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

Build = Callable[[int], DataFrame]


class Orchestrator:
    """Sources by category (price, derivatives, macro, sentiment), each a function from days to a table."""

    def __init__(self, store: Store, sources: dict[str, dict[str, Build]]):
        self.store, self.sources = store, sources

    def price(self, interval: str, days: int, refresh: bool = False) -> DataFrame:
        """The price table of an interval and a number of days, from the cache if it is there."""
        return self._one("price", interval, f"price_{interval}_{days}d", days, refresh)

    def category(self, category: str, days: int, refresh: bool = False) -> dict[str, DataFrame]:
        """All tables of a category by name. A source that fails or is empty is left out."""
        out = {}
        for name in self.sources.get(category, {}):
            try:
                df = self._one(category, name, f"{name}_{days}d", days, refresh)
                if not df.isEmpty():
                    out[name] = df
            except (OSError, TimeoutError):
                continue
        return out

    def _one(self, category: str, name: str, key: str, days: int, refresh: bool) -> DataFrame:
        build = self.sources[category][name]
        if refresh:
            self.store.save(build(days), key, category)
        return self.store.cached(key, lambda: build(days), category)

    def fetch_all(self, days: dict[str, int], refresh: bool = False, t: str = "t") -> dict[str, dict[str, DataFrame]]:
        """Every category, and its metadata written as table ``fetch_metadata``: category, name, days, rows, first and last time."""
        out = {c: self.category(c, days.get(c, 365), refresh) for c in self.sources if c != "price"}
        out["price"] = {i: self.price(i, days.get("price", 365), refresh) for i in self.sources.get("price", {})}
        rows = [df.agg(F.lit(c).alias("category"), F.lit(n).alias("name"), F.lit(days.get(c, 365)).alias("days"), F.count("*").alias("rows"), F.min(t).alias("first"), F.max(t).alias("last")) for c, tables in out.items() for n, df in tables.items()]
        if rows:
            meta = rows[0]
            for r in rows[1:]:
                meta = meta.unionByName(r)
            self.store.save(meta, "fetch_metadata")
        return out

    def metadata(self) -> DataFrame | None:
        return self.store.load("fetch_metadata")
