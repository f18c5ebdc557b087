"""What is declared about tools: argument schemas, behaviour, failure conditions, origins of values."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.values import Doc, _arrow
from stepforge.functions import jsonschema, predicates

BROADCAST_BYTES = 64 << 20
FLAGS = ("idempotent", "side_effecting", "polling", "paginated")
ROWS = """tool string, schema_json string, schema_problem string, idempotent boolean, side_effecting boolean,
  polling boolean, paginated boolean, failure_json string, schema_version string, provided array<string>,
  generated array<string>, closed array<string>, origins map<string,string>"""


@dataclass
class Tool:
    name: str
    schema: Any = None
    metadata: Doc = field(default_factory=dict)
    schema_version: str | None = None
    origins: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.origins:
            self.origins = {k: s["x-value-origin"] for k, s in self.properties().items() if isinstance(s, dict) and "x-value-origin" in s}

    def properties(self) -> Doc:
        props = self.schema.get("properties") if isinstance(self.schema, dict) else None
        return props if isinstance(props, dict) else {}

    def flag(self, name: str) -> bool:
        return bool((self.metadata or {}).get(name, False))

    @property
    def retryable_errors(self) -> list[str]:
        return list((self.metadata or {}).get("retryable_errors") or ())

    @property
    def failure(self) -> Doc | None:
        return predicates.compiled((self.metadata or {}).get("failure_when"))


class Registry:
    """Declared tools by name; an empty one declares nothing."""

    def __init__(self, tools: Iterable[Tool] = ()):
        self.tools = {t.name: t for t in tools}

    def __len__(self) -> int:
        return len(self.tools)

    def __contains__(self, name: object) -> bool:
        return name in self.tools

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self.tools.get(name)

    def names(self) -> list[str]:
        return list(self.tools)

    @classmethod
    def from_dict(cls, data: Doc) -> Registry:
        table = data["tools"] if "tools" in data else data
        made = []
        for name, d in table.items():
            schema = next((d[k] for k in ("schema", "input_schema", "parameters") if d.get(k)), None)
            made.append(Tool(name, schema, d.get("metadata") or {}, d.get("schema_version"), dict(d.get("value_origins") or {})))
        return cls(made)

    @classmethod
    def load(cls, path: str | Path) -> Registry:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def from_chat_tools(cls, tools: list[Doc]) -> Registry:
        """From the function definitions that a chat model is given."""
        out = cls()
        for t in tools:
            f = t["function"] if "function" in t else t
            if f.get("name"):
                out.add(Tool(f["name"], f.get("parameters"), f.get("metadata") or {}, f.get("schema_version")))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each tool, to be broadcast while its schemas are of BROADCAST_BYTES at most; it grows with the
        declarations, not with the traces.  A join of its own would send all calls of a tool to one task."""
        rows = []
        for t in self.tools.values():
            problem = jsonschema.schema_problem(t.schema) if t.schema is not None else None
            closed = [k for k, s in t.properties().items() if isinstance(s, dict) and ("enum" in s or "const" in s)]
            of = lambda origin, t=t: [k for k, o in t.origins.items() if o == origin]
            rows.append(
                (t.name, None if t.schema is None else json.dumps(t.schema), problem, *map(t.flag, FLAGS))
                + (None if t.failure is None else json.dumps(t.failure), t.schema_version, of("provided"), of("generated"), closed, {k: str(v) for k, v in t.origins.items()})
            )
        if not rows:
            return F.broadcast(spark.createDataFrame([], ROWS))
        kind = _arrow(f"struct<{ROWS}>")
        # Arrow goes to the executors without Python workers
        df = spark.createDataFrame(pa.Table.from_struct_array(pa.array([dict(zip(kind.names, r, strict=True)) for r in rows], kind)))
        return F.broadcast(df) if sum(len(str(r)) for r in rows) <= BROADCAST_BYTES else df
