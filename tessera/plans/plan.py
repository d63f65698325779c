"""Evaluation plans: validation, registries, kinds of payload, and the lazy run."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("cls", "semseg", "depth", "rec", "vqa", "normals", "edge", "sal", "human_parts", "det")

_registered: dict[str, Callable] = {}


def register(name: str) -> Callable[[Callable], Callable]:
    """Makes a builder known by name; a name is taken once."""

    def add(f: Callable) -> Callable:
        if name in _registered:
            raise ValueError(f"{name} is registered already")
        _registered[name] = f
        return f

    return add


def resolve(name: str) -> Callable:
    """A registered builder, or the attribute of a dotted path."""
    importlib.import_module("tessera.plans.codecs")  # registers the codecs that need operators
    if name in _registered:
        return _registered[name]
    module, _, attribute = name.rpartition(".")
    if module:
        try:
            return getattr(importlib.import_module(module), attribute)
        except (ImportError, AttributeError) as e:
            raise KeyError(name) from e
    raise KeyError(name)


def build(spec: Mapping[str, Any], **more: Any) -> Any:
    """What `type` names, called with the other fields."""
    fields = dict(spec)
    return resolve(fields.pop("type"))(**fields, **more)


@dataclass(frozen=True)
class Task:
    label: str
    meter: Mapping[str, Any]
    kind: str | None = None


@dataclass(frozen=True)
class Plan:
    name: str
    description: str
    dataset: Mapping[str, Any]
    model: Mapping[str, Any]
    tasks: Sequence[Task]
    load: Mapping[str, Any] = field(default_factory=dict)
    qualities: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)


def parse(raw: Mapping[str, Any] | None) -> Plan:
    """A checked plan; what is missing is named in the error."""
    if raw is None:
        raise ValueError("plan is required")
    for key in ("name", "description", "dataset", "task_configs", "model"):
        if raw.get(key) is None:
            raise ValueError(f"plan.{key} is required")
    if not raw["dataset"].get("type"):
        raise ValueError("plan.dataset.type is required")
    tasks = []
    for t in raw["task_configs"]:
        if not t.get("label"):
            raise ValueError("task_configs.*.label is required")
        if not isinstance(t.get("meter"), Mapping) or "type" not in t["meter"]:
            raise ValueError(f"task_configs.{t['label']}.meter needs a type")
        tasks.append(Task(t["label"], t["meter"], kind_of(t["label"], t.get("kind"))))
    return Plan(raw["name"], raw["description"], raw["dataset"], raw["model"], tuple(tasks), raw.get("load") or {}, raw.get("multi_run") or {})


def kind_of(label: str, kind: str | None = None) -> str | None:
    """The stated kind, which must be known, else the label where it is one, else none."""
    if kind is not None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        return kind
    return label if label in KINDS else None


def labels_by_kind(plan: Plan) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for t in plan.tasks:
        if t.kind:
            out.setdefault(t.kind, []).append(t.label)
    return out


def merge(base: Mapping[str, Any], patch: Mapping[str, Any]) -> dict[str, Any]:
    """A patched copy; nested mappings are merged, others replaced."""
    out = dict(base)
    for k, v in patch.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def runs(plan: Plan) -> list[tuple[str, Plan]]:
    """A plan for each quality, each from the base; one run without qualities."""
    if not plan.qualities:
        return [("", plan)]
    return [(q, replace(plan, model=merge(plan.model, patch or {}))) for q, patch in plan.qualities.items()]


class Model(Protocol):
    """The boundary for codecs and networks: encodes samples in Arrow batches on executors."""

    def encode(self, samples: DataFrame) -> DataFrame:
        """(sample_id, stream, payload)"""

    def decode(self, streams: DataFrame) -> DataFrame:
        """(sample_id, prediction columns)"""


@register("bypass")
class Bypass:
    """A codec that costs nothing: empty streams, predictions as they came."""

    def encode(self, samples: DataFrame) -> DataFrame:
        return samples.select("sample_id", F.lit("h").alias("stream"), F.lit(b"").alias("payload"))

    def decode(self, streams: DataFrame) -> DataFrame:
        return streams.select("sample_id")


@register("raw")
class Raw:
    """Values as bytes of a wire type."""

    def __init__(self, dtype: str = "float16", column: str = "vec"):
        self.dtype, self.column = dtype, column

    def encode(self, samples: DataFrame) -> DataFrame:
        from tessera.functions.wire import encode

        return samples.select("sample_id", F.lit("h").alias("stream"), encode(F.col(self.column), self.dtype).alias("payload"))

    def decode(self, streams: DataFrame) -> DataFrame:
        from tessera.functions.wire import decode

        return streams.select("sample_id", decode(F.col("payload"), self.dtype).alias(self.column))


@register("uniform")
class Uniform:
    """Clipped values in 8 bits a value."""

    def __init__(self, low: float, high: float, bits: int = 8, column: str = "vec"):
        if bits > 8:
            raise ValueError("bits must be 8 or fewer")
        self.low, self.high, self.bits, self.column = low, high, bits, column

    def encode(self, samples: DataFrame) -> DataFrame:
        from tessera.functions import quantise as q

        level = lambda x: q.uniform(q.truncate(x.cast("double"), self.low, self.high), self.low, self.high, self.bits)
        digits = F.transform(self.column, lambda x: F.lpad(F.hex(level(x).cast("long")), 2, "0"))
        return samples.select("sample_id", F.lit("h").alias("stream"), F.unhex(F.array_join(digits, "")).alias("payload"))

    def decode(self, streams: DataFrame) -> DataFrame:
        from tessera.functions import quantise as q

        text = F.hex("payload")
        values = F.transform(F.sequence(F.lit(0), F.length("payload") - 1), lambda k: q.uniform_inverse(F.conv(F.substring(text, 2 * k + 1, F.lit(2)), 16, 10).cast("int"), self.low, self.high, self.bits))
        return streams.select("sample_id", F.when(F.length("payload") > 0, values).otherwise(F.array().cast("array<double>")).alias(self.column))


def evaluate(samples: DataFrame, model: Model, meter: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rates by sample and the meter's result over decoded samples joined to their inputs; both lazy."""
    streams = model.encode(samples)
    bits = streams.groupBy("sample_id", "stream").agg(F.sum(F.octet_length("payload") * 8).alias("bits"))
    decoded = model.decode(streams)
    renamed = decoded.select("sample_id", *[F.col(c).alias(f"pred_{c}") for c in decoded.columns if c != "sample_id"])
    return bits, meter(samples.join(renamed, "sample_id"))
