"""Fields of an index and how they map to Spark types."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

SPARK_TYPES = {"text": "string", "keyword": "string", "long": "bigint", "double": "double", "boolean": "boolean", "date": "timestamp", "geo_point": "struct<lat:double,lon:double>", "dense_vector": "array<float>", "stored": "string"}
METRICS = ("cosine", "dot_product", "l2")


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    analyzer: str = "standard"
    multi: bool = False
    dims: int | None = None
    metric: str = "cosine"

    def __post_init__(self):
        if not self.name or len(self.name.encode()) > 512:
            raise SchemaError("a field name has 1 to 512 bytes")
        if self.type not in SPARK_TYPES:
            raise SchemaError(f"unknown field type {self.type!r}")
        if self.type == "dense_vector" and not 1 <= (self.dims or 0) <= 4096:
            raise SchemaError(f"{self.name}: a vector has 1 to 4096 dimensions")
        if self.metric not in METRICS:
            raise SchemaError(f"unknown metric {self.metric!r}")

    @property
    def spark_type(self) -> str:
        own = SPARK_TYPES[self.type]
        return f"array<{own}>" if self.multi and self.type != "dense_vector" else own


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    key: str = "_id"

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise SchemaError("field names repeat")

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"no field {name!r}")

    def of_type(self, *types: str) -> list[Field]:
        return [f for f in self.fields if f.type in types]

    def extended(self, fields: Sequence[Field], key: str | None = None) -> Schema:
        """A schema with documents only grows: no field goes or changes, nor does the key."""
        if key is not None and key != self.key:
            raise SchemaError("the key is frozen")
        old = {f.name: f for f in self.fields}
        for f in fields:
            if f.name in old and old[f.name] != f:
                raise SchemaError(f"field {f.name!r} is frozen")
        return Schema(self.fields + tuple(f for f in fields if f.name not in old), self.key)

    def ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f.spark_type}" for f in self.fields)

    def to_json(self) -> str:
        return json.dumps({"key": self.key, "fields": [asdict(f) for f in self.fields]})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        raw = json.loads(text)
        return cls(tuple(Field(**f) for f in raw["fields"]), raw["key"])
