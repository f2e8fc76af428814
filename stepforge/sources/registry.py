"""A catalogue of datasets: names to sources, formats and column mappings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.sources import files


@dataclass
class Entry:
    """One dataset; columns not listed become null once any are (PRJ-17)."""

    name: str
    load_from: str = "file"
    path: str = ""
    formatting: str = "alpaca"
    ranking: bool = False
    subset: str | None = None
    split: str = "train"
    num_samples: int | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, spec: dict, folder: str = "") -> Entry:
        """SRC-09: a hub name comes before a script, that before a cloud file, that
        before a local file."""
        order = (("hf_hub_url", "hf_hub"), ("ms_hub_url", "ms_hub"), ("om_hub_url", "om_hub"), ("script_url", "script"), ("cloud_file_name", "cloud"), ("file_name", "file"))
        key, kind = next(((k, v) for k, v in order if spec.get(k)), (None, None))
        if key is None:
            raise ValueError(f"{name} names no source")
        path = os.path.join(folder, spec[key]) if kind in ("file", "script") else spec[key]
        known = {f.name for f in fields(cls)} - {"name", "load_from", "path"}
        return cls(name, kind, path, **{k: v for k, v in spec.items() if k in known})


class Registry:
    """SRC-09..11: entries from a dictionary or a folder's ``dataset_info.json``."""

    def __init__(self, specs: dict[str, dict], folder: str = ""):
        self.specs, self.folder = dict(specs), folder

    @classmethod
    def open(cls, folder: str) -> Registry:
        with open(os.path.join(folder, "dataset_info.json"), encoding="utf-8") as f:
            return cls(json.load(f), folder)

    def __getitem__(self, name: str) -> Entry:
        if name not in self.specs:
            raise KeyError(f"{name} isn't registered")
        return Entry.of(name, self.specs[name], self.folder)

    def upsert(self, name: str, spec: dict) -> None:
        """SNK-12: set one entry and, with a folder, write the catalogue."""
        self.specs[name] = spec
        if self.folder:
            with open(os.path.join(self.folder, "dataset_info.json"), "w", encoding="utf-8") as f:
                json.dump(self.specs, f, ensure_ascii=False, indent=2)

    def read(self, spark: SparkSession, name: str, hubs: dict | None = None) -> DataFrame:
        """The rows of an entry; hub and script readers are injected by kind (SRC-07)."""
        e = self[name]
        if e.load_from == "file":
            df = files.load(spark, e.path)
        elif e.load_from == "cloud":
            df = files.cloud_json(spark, e.path)
        elif hubs and e.load_from in hubs:
            df = hubs[e.load_from](spark, e)
        else:
            raise NotImplementedError(f"no reader for {e.load_from} here; pass one in hubs")
        return renamed(df, e.columns)


def renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """PRJ-17: role columns from source columns; without a mapping all stay."""
    if not columns:
        return df
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).alias(role) for role, c in columns.items()))


def compatible(entries: list[Entry], ranking: bool) -> None:
    """FLT-13: all datasets of a stage are rankings or none is."""
    wrong = [e.name for e in entries if e.ranking != ranking]
    if wrong:
        raise ValueError(f"not {'' if ranking else 'non-'}ranking datasets: {wrong}")
