"""Settings and sidecars read on the driver: TOML configuration, scheduler, coverage, manifest."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import vocabulary as V
from cardmill.operators.card_rules import Scheduler
from cardmill.operators.layouts import check_mappings

COVERAGE_STATUSES = ("covered", "deferred", "unsupported", "omitted")


@dataclass(frozen=True)
class Config:
    """Where notes go: a local service, a deck, a tag, layouts per fact type."""

    url: str = "http://127.0.0.1:8765"
    sync: bool = False
    deck: str = "Study"
    tag: str = "auto"
    targets: dict[str, str] = field(default_factory=dict)


def local_url(url: str) -> str:
    """The URL, if it names this machine."""
    seen = urlparse(url)
    if seen.scheme != "http" or seen.hostname not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError(f"the note service must be local: {url!r}")
    return url


def read_config(path: str | Path) -> Config:
    """Defaults overlaid with a TOML file: tables service, defaults, target_layouts."""
    data = tomllib.loads(Path(path).read_text("utf-8")) if Path(path).exists() else {}
    service, defaults, targets = (data.get(k, {}) for k in ("service", "defaults", "target_layouts"))
    if not all(isinstance(t, dict) for t in (service, defaults, targets)):
        raise ValueError("service, defaults and target_layouts are tables")
    made = Config(service.get("url", Config.url), service.get("sync", Config.sync), defaults.get("deck", Config.deck), defaults.get("tag", Config.tag), dict(targets))
    if not isinstance(made.sync, bool) or not all(isinstance(t, str) and t.strip() for t in (made.deck, made.tag)) or len(made.tag.split()) != 1:
        raise ValueError("sync is true or false; deck and tag have text, a tag no spaces")
    if any(kind not in V.FACT_TYPES or not isinstance(name, str) or not name.strip() for kind, name in made.targets.items()):
        raise ValueError("target_layouts maps fact types to names")
    local_url(made.url)
    return made


def read_mappings(path: str | Path | None) -> dict:
    """Layout templates ``{type: {layout: {field: template}}}``; none without a file."""
    if path is None or not Path(path).exists():
        return {}
    return check_mappings(tomllib.loads(Path(path).read_text("utf-8")))


def read_scheduler(path: str | Path) -> tuple[Scheduler, list[tuple[str, str]]]:
    """Scheduler settings of a JSON sidecar and what is wrong with it: (code, level)."""
    if not Path(path).exists():
        return Scheduler(), [("SETTINGS_MISSING", "warning")]
    try:
        data = json.loads(Path(path).read_text("utf-8"))
        known = {f.name: type(getattr(Scheduler(), f.name)) for f in fields(Scheduler)}
        kept = {k: tuple(map(str, v)) if k == "learning_steps" else v for k, v in data.items() if k in known}
        if any(not isinstance(v, known[k]) or (known[k] is int and isinstance(v, bool)) for k, v in kept.items()):
            raise TypeError
        return Scheduler(**kept), []
    except (ValueError, TypeError, AttributeError):
        return Scheduler(), [("SETTINGS_INVALID", "error")]


def read_coverage(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Objectives of a coverage sidecar; a status that isn't known is an error."""
    if not Path(path).exists():
        return None, [("COVERAGE_MISSING", "warning")]
    shape = "objectives array<struct<id:string,label:string,topic:string,status:string,knowledge_units:int,represented_units:int>>"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("c")).select(F.explode("c.objectives").alias("o")).select("o.*")
    wrong = read.where(~F.coalesce(F.col("status").isin(*COVERAGE_STATUSES), F.lit(False))).limit(1).count()
    return read, [("COVERAGE_INVALID", "error")] if wrong or not read.limit(1).count() else []


def deferred_units(spark: SparkSession, path: str) -> int:
    """Units that a manifest sidecar calls deferred."""
    shape = "knowledge_units array<struct<id:string,status:string>>"
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["knowledge_units"]).alias("u"))
    return read.where("u.status = 'deferred'").count()
