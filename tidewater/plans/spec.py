"""A pipeline as data: sources, SQL, event time, windows, sink and mode; to and from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

MODES = ("streaming", "batch", "request")
SOURCES = ("datagen", "kafka", "parquet", "vector")
SINKS = ("parquet", "in_memory", "request", "count")


@dataclass(frozen=True)
class WatermarkSpec:
    """``idle_timeout_ms`` is accepted and has no effect: Spark's watermark is the query's, not a partition's, so an idle partition never holds it back."""

    out_of_orderness_ms: int = 0
    idle_timeout_ms: int | None = 1000


@dataclass(frozen=True)
class EventTimeSpec:
    watermark: WatermarkSpec = WatermarkSpec()
    allowed_lateness_ms: int = 0


@dataclass(frozen=True)
class CheckpointSpec:
    """Every micro-batch is a checkpoint: ``interval_ms`` is the trigger's, ``retained`` the batches that can be gone back to (two at least); ``timeout_ms`` has no effect."""

    interval_ms: int = 0
    timeout_ms: int = 60_000
    retained: int = 1
    location: str | None = None


@dataclass(frozen=True)
class SourceSpec:
    name: str
    kind: str
    schema: dict | None = None
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class SinkSpec:
    kind: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineSpec:
    sql: str
    sources: tuple[SourceSpec, ...]
    sink: SinkSpec | None = None
    mode: str = "batch"
    parallelism: int | None = None
    event_time: EventTimeSpec = EventTimeSpec()
    tiles_ms: tuple[int, ...] = ()
    checkpoint: CheckpointSpec = CheckpointSpec()
    request: dict | None = None
    exact_ties: bool = True
    sequence: str | None = None

    def validate(self) -> PipelineSpec:
        if not self.sql.strip():
            raise ValueError("sql is empty")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        names = [s.name for s in self.sources]
        if len(set(names)) != len(names):
            raise ValueError("source names must differ")
        for s in self.sources:
            if s.kind not in SOURCES:
                raise ValueError(f"{s.name}: source is one of {SOURCES}")
        if self.sink and self.sink.kind not in SINKS:
            raise ValueError(f"sink is one of {SINKS}")
        if self.sink and self.sink.kind == "request" and self.mode != "request":
            raise ValueError("the request sink answers requests: it needs the mode request")
        if self.mode == "request" and not self.request:
            raise ValueError("request mode needs a request source")
        c = self.checkpoint
        if c.interval_ms < 0 or (c.interval_ms and (c.timeout_ms <= 0 or c.retained < 1 or not c.location)):
            raise ValueError("checkpoints need a location, a timeout and one retained copy at least")
        if self.tiles_ms:
            from ..operators.tiling import check_tiles

            check_tiles(self.tiles_ms)
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> PipelineSpec:
        raw = json.loads(text)
        event = raw.pop("event_time", None)
        made = {"sources": tuple(SourceSpec(**s) for s in raw.pop("sources"))}
        if event:
            made["event_time"] = EventTimeSpec(WatermarkSpec(**event.get("watermark", {})), event.get("allowed_lateness_ms", 0))
        if sink := raw.pop("sink", None):
            made["sink"] = SinkSpec(**sink)
        if checkpoint := raw.pop("checkpoint", None):
            made["checkpoint"] = CheckpointSpec(**checkpoint)
        if "tiles_ms" in raw:
            made["tiles_ms"] = tuple(raw.pop("tiles_ms"))
        return PipelineSpec(**raw, **made).validate()


class PipelineBuilder:
    """Fluent form: ``PipelineBuilder().source(...).sql(...).sink(...).build()``."""

    def __init__(self) -> None:
        self._spec, self._sources = PipelineSpec("", ()), []

    def source(self, name: str, kind: str, schema: dict | None = None, **options) -> PipelineBuilder:
        if any(s.name == name for s in self._sources):
            raise ValueError(f"a source named {name!r} exists")
        self._sources.append(SourceSpec(name, kind, schema, options))
        return self

    def sink(self, kind: str, **options) -> PipelineBuilder:
        return self._with(sink=SinkSpec(kind, options))

    def sql(self, text: str) -> PipelineBuilder:
        return self._with(sql=text)

    def mode(self, name: str) -> PipelineBuilder:
        return self._with(mode=name)

    def event_time(self, out_of_orderness_ms: int = 0, allowed_lateness_ms: int = 0, idle_timeout_ms: int | None = 1000) -> PipelineBuilder:
        return self._with(event_time=EventTimeSpec(WatermarkSpec(out_of_orderness_ms, idle_timeout_ms), allowed_lateness_ms))

    def option(self, **values) -> PipelineBuilder:
        return self._with(**values)

    def build(self) -> PipelineSpec:
        return replace(self._spec, sources=tuple(self._sources)).validate()

    def _with(self, **values) -> PipelineBuilder:
        self._spec = replace(self._spec, **values)
        return self
