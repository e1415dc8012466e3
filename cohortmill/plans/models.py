"""Models that build on each other: sources, and models with the names of what they need, built once a run.

A `view` stays a lazy plan, so its readers compute only the columns they ask for. A `shared` model is written once, at its
first use, and read from there by all that need it. A `table` is written, tested and published under its name, and
later runs and other sessions read it by name. Each model is built at most once a run, after what it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortmill.functions.storage import scratch, written
from cohortmill.sources.publish import Published, Test

KINDS = ("view", "shared", "table")


@dataclass(frozen=True)
class Model:
    name: str
    build: Callable[..., DataFrame]
    needs: tuple[str, ...]
    kind: str
    tests: tuple[Test, ...] = ()


class Models:
    """A registry of one run. root: the folder of its published tables (a new one, if none is named)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.models: dict[str, Model] = {}
        self.frames: dict[str, DataFrame] = {}
        self._root = root
        self.builds: dict[str, int] = {}

    @property
    def tables(self) -> Published:
        self._root = self._root or scratch(self.spark)
        return Published(self.spark, self._root)

    def source(self, name: str, build: Callable[[], DataFrame]) -> None:
        self.model(name, build)

    def model(self, name: str, build: Callable[..., DataFrame], needs: Sequence[str] = (), kind: str = "view", tests: Sequence[Test] = ()) -> None:
        """build gets the frames of `needs`, in their order. tests (failing rows) are for tables."""
        if name in self.models:
            raise ValueError(f"{name!r} is registered twice")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if tests and kind != "table":
            raise ValueError("only tables are tested before they are published")
        self.models[name] = Model(name, build, tuple(needs), kind, tuple(tests))

    def order(self, *names: str) -> list[str]:
        """The models that these need, themselves included, each after what it needs; all models, if none is named."""
        out: list[str] = []
        path: list[str] = []

        def visit(name: str) -> None:
            if name in out:
                return
            if name in path:
                raise ValueError("models need each other: " + " -> ".join([*path[path.index(name) :], name]))
            if name not in self.models:
                raise ValueError(f"unknown model {name!r}" + (f", needed by {path[-1]!r}" if path else ""))
            path.append(name)
            for need in self.models[name].needs:
                visit(need)
            path.pop()
            out.append(name)

        for name in names or self.models:
            visit(name)
        return out

    def needed_by(self, name: str) -> list[str]:
        """The models that would have to be built again after a change of this one, in their order."""
        changed = {name}
        for other in self.order():
            if changed & set(self.models[other].needs):
                changed.add(other)
        return [x for x in self.order() if x in changed and x != name]

    def frame(self, name: str) -> DataFrame:
        """The model's rows; what it needs and isn't built yet is built before."""
        for each in self.order(name):
            if each not in self.frames:
                m = self.models[each]
                made = m.build(*(self.frames[x] for x in m.needs))
                if m.kind == "shared":
                    made = written(made)
                elif m.kind == "table":
                    made = self.tables.publish(each, made, m.tests)
                self.frames[each] = made
                self.builds[each] = self.builds.get(each, 0) + 1
        return self.frames[name]

    def forget(self, *names: str) -> None:
        """The named models, and what needs them, are built again when next asked for; all else stays as it is built."""
        for name in {n for x in names for n in (x, *self.needed_by(x))}:
            self.frames.pop(name, None)

    def run(self, *names: str) -> list[str]:
        """Build the named models (all, if none is named); gives the tables that were published."""
        for name in self.order(*names):
            self.frame(name)
        return [x for x in self.order(*names) if self.models[x].kind == "table"]
