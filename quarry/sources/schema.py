"""Index schemas: text fields, each with the name of its analyzer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXT = "text"


class SchemaError(ValueError):
    """A schema that is not valid, or documents that don't fit it."""


@dataclass(frozen=True)
class TextField:
    """A field; its id is its place in the schema."""

    id: int
    name: str
    analyzer: str = "default"
    type: str = TEXT


@dataclass(frozen=True)
class IndexSchema:
    fields: tuple[TextField, ...] = ()

    @classmethod
    def of(cls, *names: str, **analyzers: str) -> IndexSchema:
        """Fields with the default analyzer by name, then those given as ``name=analyzer``."""
        schema = cls()
        for name in names:
            schema = schema.add_text_field(name)
        for name, analyzer in analyzers.items():
            schema = schema.add_text_field(name, analyzer)
        return schema

    def add_text_field(self, name: str, analyzer: str = "default") -> IndexSchema:
        if not name or name == "doc_id" or ":" in name or " " in name:
            raise SchemaError(f"{name!r} can't name a field")
        if any(f.name == name for f in self.fields):
            raise SchemaError(f"field {name!r} is there already")
        return IndexSchema((*self.fields, TextField(len(self.fields), name, analyzer)))

    def field(self, name: str) -> TextField | None:
        return next((f for f in self.fields if f.name == name), None)

    def by_id(self, field_id: int) -> TextField:
        return self.fields[field_id]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def to_json(self) -> list[dict[str, object]]:
        return [{"id": f.id, "name": f.name, "type": f.type, "analyzer": f.analyzer} for f in self.fields]

    @classmethod
    def from_json(cls, entries: list[dict]) -> IndexSchema:
        schema = cls()
        for entry in entries:
            if entry.get("type", TEXT) != TEXT:
                raise SchemaError(f"field type {entry['type']!r} is not supported")
            schema = schema.add_text_field(entry["name"], entry["analyzer"])
        return schema

    def struct(self) -> T.StructType:
        """The documents' columns, the analyzer being each field's metadata."""
        fields = [T.StructField(f.name, T.StringType(), True, {"analyzer": f.analyzer}) for f in self.fields]
        return T.StructType([T.StructField("doc_id", T.LongType(), False), *fields])

    def check(self, docs: DataFrame) -> None:
        """Fields that documents have must be strings or arrays of strings; missing ones are allowed."""
        for f in self.fields:
            if f.name in docs.columns:
                kind = docs.schema[f.name].dataType
                repeated = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)
                if not repeated and not isinstance(kind, T.StringType):
                    raise SchemaError(f"field {f.name!r} is {kind.simpleString()}, not a string or an array of strings")
