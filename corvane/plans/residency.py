"""Which models a Python worker keeps in memory, and measurements of stages.

Executors' memory is Spark's concern (resource profiles); within one worker several
models may still not fit side by side. A budget loads them when a stage asks and drops
what is needed least.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class _Model:
    load: Callable[[], Any]
    megabytes: float
    priority: int
    held: Any = None


class ModelBudget:
    """Models by name under a limit of megabytes, of which `margin` stays free."""

    def __init__(self, megabytes: float, margin: float = 0.0):
        self.limit = megabytes - margin
        self._models: dict[str, _Model] = {}
        self._loaded: list[str] = []  # in the order of loading

    def register(self, name: str, load: Callable[[], Any], megabytes: float, priority: int = 0) -> None:
        self._models[name] = _Model(load, megabytes, priority)

    def used(self) -> float:
        return sum(self._models[n].megabytes for n in self._loaded)

    def can_fit(self, name: str) -> bool:
        return name in self._loaded or self.used() + self._models[name].megabytes <= self.limit

    def prepare(self, name: str, then: tuple[str, ...] = ()) -> Any:
        """The model, loaded; to make room, others go by rising priority, the last loaded of equals first, those in `then` only if nothing else helps."""
        if name not in self._models:
            raise KeyError(name)
        for spare in (set(then), set()):
            for victim in sorted((n for n in self._loaded if n != name and n not in spare), key=lambda n: (self._models[n].priority, -self._loaded.index(n))):
                if self.can_fit(name):
                    break
                self.unload(victim)
        if not self.can_fit(name):
            raise MemoryError(f"{name} takes {self._models[name].megabytes} MB of {self.limit}")
        if name not in self._loaded:
            self._models[name].held = self._models[name].load()
            self._loaded.append(name)
        return self._models[name].held

    def finish(self, name: str, then: tuple[str, ...] = ()) -> None:
        """Drops a stage's model if other stages come after it and none needs it; after the last stage it stays."""
        if then and name not in then:
            self.unload(name)

    def unload(self, name: str) -> None:
        """Lets go of a model; one that has a method `unload` is asked to."""
        if name in self._loaded:
            self._loaded.remove(name)
            getattr(self._models[name].held, "unload", lambda: None)()
            self._models[name].held = None

    def unload_all(self) -> None:
        for name in reversed(list(self._loaded)):
            self.unload(name)

    def known(self) -> list[str]:
        return list(self._models)

    def loaded(self) -> list[str]:
        return list(self._loaded)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with a row count that is known once it has been written, without a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class StageLog:
    """One JSON line per stage: its name, seconds and rows."""

    def __init__(self, write: Callable[[str], Any] = print):
        self._write = write

    @contextmanager
    def stage(self, name: str) -> Iterator[dict]:
        began, told = time.time(), {"stage": name}
        try:
            yield told
        finally:
            self._write(json.dumps(told | {"seconds": round(time.time() - began, 3)}))
