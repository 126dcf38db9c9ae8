"""What users plug in: operators by name with checked arguments, encoders, extractors and scorers."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Tool:
    """A named DataFrame operator with the names and types of its arguments."""

    name: str
    run: Callable[..., DataFrame]
    arguments: dict[str, type] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def check(self, given: dict) -> str | None:
        """The first fault of the arguments, or None. Unknown names pass."""
        if not isinstance(given, dict):
            return "arguments are not a map"
        for name in self.required:
            if name not in given:
                return f"missing {name}"
        for name, kind in self.arguments.items():
            if name in given and kind in (int, float, str, list, dict, bool) and not isinstance(given[name], (int, float, bool) if kind in (int, float) else kind):
                return f"{name} is no {kind.__name__}"
        return None

    def __call__(self, **given) -> DataFrame:
        if fault := self.check(given):
            raise ValueError(f"{self.name}: {fault}")
        return self.run(**given)


_tools: dict[str, Tool] = {}
#: Tools that an environment offers.
ENVIRONMENTS: dict[str, list[str]] = {"search": ["search"], "all": ["search", "insert", "update", "delete"], "no_insert": ["search", "update", "delete"]}


def tool(name: str | None = None) -> Callable:
    """Registers a function as a tool; its signature gives the arguments."""

    def made(f: Callable) -> Callable:
        ps = inspect.signature(f).parameters.values()
        kinds = {"int": int, "float": float, "str": str, "list": list, "dict": dict, "bool": bool}
        args = {p.name: kinds[p.annotation if isinstance(p.annotation, str) else p.annotation.__name__] for p in ps if (p.annotation if isinstance(p.annotation, str) else getattr(p.annotation, "__name__", "")) in kinds}
        t = Tool(name or f.__name__, f, args, tuple(p.name for p in ps if p.default is inspect.Parameter.empty))
        _tools[t.name] = t
        return f

    return made


def get(name: str) -> Tool:
    if name not in _tools:
        raise KeyError(f"unknown tool {name!r}")
    return _tools[name]


def offered(environment: str) -> list[str]:
    return [n for n in ENVIRONMENTS.get(environment, []) if n in _tools]
