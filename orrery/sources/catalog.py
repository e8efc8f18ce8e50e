"""A content-addressed catalog: each item lies in a folder named by the hash of its properties."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.files import children, exists, read_text, remove, write_text


def canonical(properties: dict[str, Any]) -> str:
    """The canonical JSON of properties: sorted keys, blanks after commas and colons."""
    return json.dumps(properties, sort_keys=True)


def content_id(properties: dict[str, Any]) -> str:
    return hashlib.sha256(canonical(properties).encode("utf-8")).hexdigest()


# -- a catalog as a frame (item_id, properties): filters that Catalyst prunes


def property_of(properties: Column | str, name: str) -> Column:
    """A property as text, null where it is absent; strings come without quotes."""
    return F.get_json_object(properties, f"$.{name}")


def resolve_items(catalog: DataFrame, item_key: str | None = None, item_col: str = "item_id", json_col: str = "properties", **properties: Any) -> DataFrame:
    """Items whose id starts with `item_key` and whose properties equal the given ones; an absent property equals None."""
    out = catalog if item_key is None else catalog.where(F.col(item_col).startswith(item_key))
    for name, value in properties.items():
        wanted = F.lit(None if value is None else value if isinstance(value, str) else json.dumps(value)).cast("string")
        out = out.where(property_of(json_col, name).eqNullSafe(wanted))
    return out


def conflicts(catalog: DataFrame, new: DataFrame, item_col: str = "item_id", json_col: str = "properties") -> DataFrame:
    """(item_id) of new items (a frame with their canonical JSON) that the catalog holds already."""
    return new.select(F.sha2(F.col(json_col), 256).alias(item_col)).distinct().join(catalog.select(item_col), item_col, "left_semi")


class DiskCatalog:
    """Items of one class under a folder of any file system. Nothing is created until the first item is added."""

    def __init__(self, spark: SparkSession, root: str, item_class: str = "item", loader: Callable[[SparkSession, str], Any] | None = None) -> None:
        self.spark, self.root, self.item_class, self.loader = spark, root.rstrip("/"), item_class, loader
        info = f"{self.root}/info.json"
        if exists(spark, info):
            held = json.loads(read_text(spark, info))["item_class"]
            if held != item_class:
                raise ValueError(f"the catalog holds {held}")

    def __len__(self) -> int:
        return self.frame().count()

    def frame(self) -> DataFrame:
        """(item_id, properties) of all items, read by tasks."""
        if not any(exists(self.spark, f"{self.root}/{name}/properties.json") for name in children(self.spark, self.root)):
            return self.spark.createDataFrame([], "item_id string, properties string")
        rows = self.spark.read.text(f"{self.root}/*/properties.json", wholetext=True)
        return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("item_id"), F.col("value").alias("properties"))

    def add_item(self, properties: dict[str, Any], save: Callable[[str], None] | None = None) -> str:
        return self.add_items([(properties, save)])[0]

    def add_items(self, items: Iterable[tuple[dict[str, Any], Callable[[str], None] | None]]) -> list[str]:
        """All or none: every item is checked before the first is written. `save` gets the item's folder."""
        items = list(items)
        ids = []
        for properties, _ in items:
            if not properties:
                raise ValueError("an item needs properties")
            ids.append(content_id(properties))
        if len(set(ids)) != len(ids) or any(exists(self.spark, f"{self.root}/{i}") for i in ids):
            raise FileExistsError("items exist already or repeat")
        if not exists(self.spark, f"{self.root}/info.json"):
            write_text(self.spark, f"{self.root}/info.json", json.dumps({"item_class": self.item_class, "version": 1}))
        try:  # an item counts from when its properties.json is there, which is written when all contents are
            for item, (_, save) in zip(ids, items):
                if save:
                    save(f"{self.root}/{item}")
            for item, (properties, _) in zip(ids, items):
                write_text(self.spark, f"{self.root}/{item}/properties.json", json.dumps(properties, indent=4, sort_keys=True))
        except BaseException:
            for item in ids:
                remove(self.spark, f"{self.root}/{item}")
            raise
        return ids

    def resolve(self, item_key: str | None = None, **properties: Any) -> DataFrame:
        """(item_id, properties) of the items that match: a filter over the files, run by tasks. A key that starts no id raises."""
        frame = self.frame()
        if item_key is not None and frame.where(F.col("item_id").startswith(item_key)).isEmpty():
            raise KeyError(item_key)
        return resolve_items(frame, item_key, **properties)

    def get_items(self, item_key: str | None = None, **properties: Any) -> dict[str, dict[str, Any]]:
        out = {r.item_id: json.loads(r.properties) for r in self.resolve(item_key, **properties).orderBy("item_id").toLocalIterator()}
        wrong = [k for k, p in out.items() if content_id(p) != k]
        if wrong:
            raise ValueError(f"not the hash of their properties: {wrong}")
        return out

    def get_items_key(self, item_key: str | None = None, **properties: Any) -> list[str]:
        return list(self.get_items(item_key, **properties))

    def _one(self, item_key: str | None, properties: dict[str, Any]) -> tuple[str, dict[str, Any]]:
        matching = self.get_items(item_key, **properties)
        match list(matching.items()):
            case [item]:
                return item
            case []:
                raise KeyError(properties)
        raise ValueError(f"ambiguous: {len(matching)} items match")

    def get_item_key(self, item_key: str | None = None, **properties: Any) -> str:
        return self._one(item_key, properties)[0]

    def get_item(self, item_key: str | None = None, **properties: Any) -> dict[str, Any]:
        return self._one(item_key, properties)[1]

    def get_item_path(self, item_key: str | None = None, **properties: Any) -> str:
        return f"{self.root}/{self.get_item_key(item_key, **properties)}"

    def load_item(self, item_key: str | None = None, **properties: Any) -> Any:
        return self.loader(self.spark, self.get_item_path(item_key, **properties))

    def load_items(self, item_key: str | None = None, **properties: Any) -> dict[str, Any]:
        return {k: self.loader(self.spark, f"{self.root}/{k}") for k in self.get_items_key(item_key, **properties)}

    def remove_items(self, item_key: str | None = None, **properties: Any) -> list[str]:
        """Without arguments everything goes."""
        gone = self.get_items_key(item_key, **properties)
        for k in gone:
            remove(self.spark, f"{self.root}/{k}")
        return gone

    def remove_item(self, item_key: str | None = None, **properties: Any) -> str:
        k = self.get_item_key(item_key, **properties)
        remove(self.spark, f"{self.root}/{k}")
        return k

    def clear(self) -> None:
        self.remove_items()


class Nexus:
    """Three catalogs side by side, opened on first use."""

    def __init__(self, spark: SparkSession, root: str, loaders: dict[str, Callable] | None = None) -> None:
        self.spark, self.root, self.loaders, self._open = spark, root, loaders or {}, {}

    def __getattr__(self, name: str) -> DiskCatalog:
        if name not in ("correspondences", "spaces", "decoders"):
            raise AttributeError(name)
        if name not in self._open:
            self._open[name] = DiskCatalog(self.spark, f"{self.root}/{name}", name, self.loaders.get(name))
        return self._open[name]
