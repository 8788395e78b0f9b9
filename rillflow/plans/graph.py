"""The pipeline: a tree of named steps from one source to its sinks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from ..errors import InvalidPipelineError
from .steps import Branch, Broadcast, Function, Router, Sink, Source, Step, StreamSource


class Pipeline:
    """Built by chaining; closed by a sink, a router or a broadcast."""

    def __init__(self, root: Source | Branch) -> None:
        self.root = root
        self.steps: dict[str, Step] = {root.name: root}
        self.children: dict[str, list[str]] = {}
        self._last: Step = root
        self._closed = False

    def _append(self, step: Step) -> None:
        if self._closed:
            raise InvalidPipelineError(f"step {step.name}: the pipeline is closed")
        self._adopt(step)
        self.children.setdefault(self._last.name, []).append(step.name)
        self._last = step

    def _adopt(self, step: Step) -> None:
        if step.name in self.steps:
            raise InvalidPipelineError(f"step {step.name} exists already")
        self.steps[step.name] = step

    def apply(self, step: Step) -> Pipeline:
        self._append(step)
        return self

    def sink(self, step: Sink) -> Pipeline:
        self._append(step)
        self._closed = True
        return self

    def _fork(self, step: Step, branches: Sequence[Pipeline]) -> Pipeline:
        for b in branches:
            if isinstance(b.root, Source):
                raise InvalidPipelineError(f"step {step.name}: a pipeline with its own source can't be a branch")
        self._append(step)
        self._closed = True
        for b in branches:
            for s in b.steps.values():
                self._adopt(s)
            for parent, names in b.children.items():
                self.children.setdefault(parent, []).extend(names)
            self.children.setdefault(step.name, []).append(b.root.name)
        return self

    def broadcast(self, name: str, routes: Sequence[Pipeline]) -> Pipeline:
        """Every branch gets every message."""
        return self._fork(Broadcast(name, [r.root.name for r in routes]), routes)

    def route(self, name: str, routing_function: Function, routing_table: Mapping[Any, Pipeline]) -> Pipeline:
        """Each message goes to the branch of its key."""
        distinct = list({id(p): p for p in routing_table.values()}.values())
        return self._fork(Router(name, routing_function, {k: p.root.name for k, p in routing_table.items()}), distinct)

    def walk(self) -> Iterator[tuple[str | None, Step]]:
        """(parent, step) from the root, breadth first."""
        queue: list[tuple[str | None, str]] = [(None, self.root.name)]
        while queue:
            parent, name = queue.pop(0)
            yield parent, self.steps[name]
            queue += [(name, c) for c in self.children.get(name, [])]

    def validate(self) -> None:
        """Every leaf must be a sink, and every step valid."""
        leaves = [n for n, s in self.steps.items() if not self.children.get(n) and not isinstance(s, Sink)]
        if leaves:
            raise InvalidPipelineError(f"steps that end a branch without being sinks: {', '.join(leaves)}")
        for s in self.steps.values():
            s.validate()


def streaming_source(name: str, stream_name: str, **options: Any) -> Pipeline:
    """A pipeline that reads a stream."""
    return Pipeline(StreamSource(name, stream_name, **options))


def branch(name: str) -> Pipeline:
    """The beginning of a branch of a router or broadcast."""
    return Pipeline(Branch(name))
