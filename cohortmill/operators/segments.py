"""Stored audiences: their definitions and ids as published tables, created, computed again, updated and deleted by id.

An audience's ids and its definition are published as one version each, so readers and other audiences that name it see the
last whole one while the next is computed. An audience that others name as a member can't be deleted while they are stored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.operators.segment import Engine
from cohortmill.plans import rules
from cohortmill.sources.publish import Published

_DEFINITIONS = "segment_definitions"
_SCHEMA = "segment_id string, name string, definition string, customers long, computed_at string"


@dataclass(frozen=True)
class Stored:
    segment_id: str
    name: str
    definition: dict
    customers: int
    computed_at: str


def members_of(definition: dict) -> set[str]:
    """The stored audiences that a definition names, as conditions or as members of its set operation."""

    def walk(node) -> Iterator[str]:
        if isinstance(node, dict):
            if node.get("segment_id") is not None:
                yield str(node["segment_id"])
            for value in node.values():
                yield from walk(value)
        elif isinstance(node, list):
            for value in node:
                yield from walk(value)

    named = {m for m in definition.get("set_members", []) if isinstance(m, str)}
    return named | set(walk(definition))


class Segments:
    """The stored audiences of an engine's brand, under one folder of published tables."""

    def __init__(self, engine: Engine, tables: Published):
        self.engine, self.tables = engine, tables
        for s in self.all():
            engine.brand.segments[s.segment_id] = tables.read(self._table(s.segment_id))

    @staticmethod
    def _table(segment_id: str) -> str:
        return f"segment_{segment_id}"

    def all(self) -> list[Stored]:
        """All stored audiences, by id. Definitions are as many as people wrote, so they go through the driver."""
        if not self.tables.versions(_DEFINITIONS):
            return []
        rows = self.tables.read(_DEFINITIONS).orderBy("segment_id").collect()
        return [Stored(r.segment_id, r.name, json.loads(r.definition), r.customers, r.computed_at) for r in rows]

    def get(self, segment_id: str) -> Stored:
        found = [s for s in self.all() if s.segment_id == segment_id]
        if not found:
            raise ValueError(f"segment {segment_id!r} is not stored")
        return found[0]

    def ids(self, segment_id: str) -> DataFrame:
        self.get(segment_id)
        return self.tables.read(self._table(segment_id))

    def create(self, segment_id: str, definition: dict, name: str | None = None, at: str = "") -> Stored:
        if any(s.segment_id == segment_id for s in self.all()):
            raise ValueError(f"segment {segment_id!r} is stored already")
        return self._store(segment_id, name or segment_id, definition, at)

    def update(self, segment_id: str, definition: dict | None = None, name: str | None = None, at: str = "") -> Stored:
        """A new definition, a new name, or both. The audience is computed again; what fails to compute leaves the old one."""
        old = self.get(segment_id)
        return self._store(segment_id, name or old.name, old.definition if definition is None else definition, at)

    def compute(self, segment_id: str, at: str = "") -> Stored:
        """The audience again, over the tables as they are now; what it names is taken as it is stored."""
        return self.update(segment_id, at=at)

    def delete(self, segment_id: str) -> None:
        self.get(segment_id)
        users = [s.segment_id for s in self.all() if segment_id in members_of(s.definition)]
        if users:
            raise ValueError(f"segment {segment_id!r} is a member of {', '.join(users)}")
        self._define([s for s in self.all() if s.segment_id != segment_id])
        self.engine.brand.segments.pop(segment_id, None)
        self.tables.drop(self._table(segment_id))

    def _store(self, segment_id: str, name: str, definition: dict, at: str) -> Stored:
        if segment_id in self._reach(definition):
            raise ValueError(f"segment {segment_id!r} can't be a member of itself")
        ids = self.engine.segment(rules.parse_definition(definition)).select("customer_id").where(F.col("customer_id").isNotNull())
        self.engine.brand.segments[segment_id] = built = self.tables.publish(self._table(segment_id), ids)
        stored = Stored(segment_id, name, definition, built.count(), at)
        self._define([*(s for s in self.all() if s.segment_id != segment_id), stored])
        return stored

    def _reach(self, definition: dict) -> set[str]:
        """All stored audiences that a definition names, directly or through others."""
        stored = {s.segment_id: s.definition for s in self.all()}
        seen: set[str] = set()
        todo = members_of(definition)
        while todo:
            seen |= todo
            todo = {m for s in todo if s in stored for m in members_of(stored[s])} - seen
        return seen

    def _define(self, stored: list[Stored]) -> None:
        rows = [(s.segment_id, s.name, json.dumps(s.definition), s.customers, s.computed_at) for s in stored]
        self.tables.publish(_DEFINITIONS, self.tables.spark.createDataFrame(rows, _SCHEMA))
