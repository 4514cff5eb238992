"""Run profiles, and the models that they name.

A profile says for each role (embedder, classifier, refiner) either a built-in or the path
of a factory, 'package.module.name'.  Plans ask `loader` for a function that makes the model
inside a Python worker, once for each model and configuration.
"""

from __future__ import annotations

import importlib
import inspect
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from corvane.functions import classify, embed, refine
from corvane.plans.residency import ModelBudget

#: Factories of the built-in stand-ins by role and name.
BUILT_IN = {
    ("classifier", "zero-shot"): lambda: classify.keyword_zero_shot,
    ("refiner", "echo"): lambda: refine.echo_model,
}
#: Where load_profile looks if it is given nothing.
PROFILE_FILES = ("corvane.yaml", "corvane.yml", "config/corvane.yaml")

#: Megabytes that the models of one process may take together, from CORVANE_MODEL_MB; a model's own come from `memory_mb` of its configuration.
_budget = ModelBudget(float(os.environ.get("CORVANE_MODEL_MB", "inf")))


def find(path: str) -> Any:
    """What a path 'package.module.name' names; ImportError if there is nothing."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ImportError(f"no component {path}")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ImportError(f"no component {path}") from e


def make(factory: Callable, config: dict) -> Any:
    """Calls a factory with what it takes: the whole configuration as `config`, or those entries that it has parameters for."""
    takes = inspect.signature(factory).parameters
    if "config" in takes:
        return factory(config=config)
    if any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        return factory(**config)
    return factory(**{k: v for k, v in config.items() if k in takes})


def model(path: str, config: dict) -> Any:
    """This process's model of a path and configuration: made once, unless others needed its memory meanwhile."""
    name = f"{path} {json.dumps(config, sort_keys=True, default=str)}"
    if name not in _budget.known():
        _budget.register(name, lambda: make(find(path), config), float(config.get("memory_mb", 0)), int(config.get("priority", 0)))
    return _budget.prepare(name)


def held_models() -> list[str]:
    """The paths of the models that this process holds."""
    return [name.partition(" ")[0] for name in _budget.loaded()]


def drop_models() -> None:
    """Lets go of this process's models."""
    _budget.unload_all()


@dataclass(frozen=True)
class Profile:
    """Which optional stages run, and with what."""

    name: str = "default"
    classifier: str | None = None  # "rules", "zero-shot", a factory's path, or none
    refiner: str | bool | None = "echo"  # "echo" (also True), a factory's path, or none
    embedder: str = "hashing"  # or a factory's path
    dimension: int | None = 64  # none: what the embedder's name tells
    segment_threshold: float = 0.5
    options: dict = field(default_factory=dict)  # by role: the factory's configuration

    @property
    def width(self) -> int:
        return self.dimension or embed.embedding_dimension(self.embedder)

    @property
    def version(self) -> str:
        return embed.version_id(self.embedder, self.width)


def loader(profile: Profile, role: str) -> Callable[[], Any]:
    """Makes the model of a role; to be called in a Python worker. Wrong paths are told at once, on the driver."""
    named = getattr(profile, role)
    named = "echo" if named is True else named
    if (role, named) in BUILT_IN:
        return BUILT_IN[role, named]
    find(named)
    config = dict(profile.options.get(role) or {})
    return lambda: model(named, config)


PROFILES = {
    "default": Profile(),
    "lite": Profile("lite", classifier="rules", refiner=None),
    "express": Profile("express", refiner=None),
}


def load_profile(name_or_path: str | None = None) -> Profile:
    """A profile by name, or from a YAML file that names its differences to one; without a name the first file of PROFILE_FILES that is there, else 'default'."""
    if name_or_path is None:
        name_or_path = next((p for p in PROFILE_FILES if Path(p).exists()), "default")
    if name_or_path in PROFILES:
        return PROFILES[name_or_path]
    path = Path(name_or_path)
    if not path.exists():
        raise FileNotFoundError(name_or_path)
    told = yaml.safe_load(path.read_text()) or {}
    base = PROFILES[told.pop("profile", "default")]
    known = {k: v for k, v in told.items() if k in Profile.__dataclass_fields__ and k != "options"}
    more = {k: v for k, v in told.items() if k not in Profile.__dataclass_fields__} | told.get("options", {})
    return Profile(**{**base.__dict__, **known, "options": {**base.options, **more}})


def save_profile(profile: Profile, path: str) -> None:
    Path(path).write_text(yaml.safe_dump(dict(profile.__dict__), allow_unicode=True))
