"""Linear pipelines of modules: manifests, links between outputs and inputs, a context, and a runner.

This is control only: modules are functions from parameters (among them DataFrames or paths) to named outputs, and Spark
does the work when an output is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from inspect import signature
from pathlib import Path
from typing import Any


@dataclass
class Module:
    """A module: its function, parameter declarations and default links (parameter to ``module.output``)."""

    name: str
    run: Callable[..., dict]
    parameters: list[dict] = field(default_factory=list)
    links: dict[str, str] = field(default_factory=dict)
    unfinished: bool = False


class Context:
    """Outputs of modules by name; empty outputs aren't kept."""

    def __init__(self, values: dict[str, dict[str, Any]] | None = None):
        self.values = {m: {k: v for k, v in out.items() if not _empty(v)} for m, out in (values or {}).items()}

    def put(self, module: str, outputs: dict[str, Any]) -> None:
        self.values.setdefault(module, {}).update({k: v for k, v in outputs.items() if not _empty(v)})

    def get(self, link: str) -> Any:
        """The output that ``module.key`` names, or None; also for links that aren't of that form."""
        module, dot, key = (link or "").partition(".")
        return self.values.get(module, {}).get(key) if dot and module and key else None

    def save(self, path: str) -> None:
        plain = {m: {k: v for k, v in out.items() if isinstance(v, str | int | float | bool | list | dict)} for m, out in self.values.items()}
        Path(path).write_text(json.dumps(plain))

    @classmethod
    def load(cls, path: str) -> Context:
        file = Path(path)
        return cls(json.loads(file.read_text()) if file.exists() else {})


def _empty(v: Any) -> bool:
    return v is None or (isinstance(v, str | list | dict) and not v)


def effective_links(defaults: dict[str, str], own: dict[str, str] | None) -> dict[str, str]:
    """The user's links over the manifest's; an empty one unlinks."""
    return {k: v for k, v in {**defaults, **(own or {})}.items() if v}


def configured(module: Module, params: dict[str, Any], links: dict[str, str]) -> bool:
    """Whether every required parameter has a value or a link."""
    return all(not p.get("required") or p["name"] in links or not _empty(params.get(p["name"])) for p in module.parameters)


def ordered(config: dict[str, dict], modules: dict[str, Module]) -> list[str]:
    """Enabled modules by their order; each must have one, and unfinished modules don't count."""
    on = [m for m, c in config.items() if c.get("enabled") and m in modules and not modules[m].unfinished]
    if without := [m for m in on if c_order(config[m]) is None]:
        raise ValueError(f"modules without an order: {without}")
    return sorted(on, key=lambda m: c_order(config[m]))


def c_order(entry: dict) -> int | None:
    return entry.get("execution_order")


def compacted(config: dict[str, dict], removed: str) -> dict[str, dict]:
    """The configuration without one module's place; later ones move up."""
    gone = c_order(config.get(removed, {}))
    out = {m: dict(c) for m, c in config.items()}
    for m, c in out.items():
        if m == removed:
            c["execution_order"] = None
        elif gone is not None and c_order(c) is not None and c_order(c) > gone:
            c["execution_order"] -= 1
    return out


def execute(names: list[str], modules: dict[str, Module], params: dict[str, dict], context: Context, own_links: dict[str, dict] | None = None, log: Callable[[str], None] = lambda _: None, cancelled: Callable[[], bool] = lambda: False) -> bool:
    """Runs modules in order and stops at the first failure; True if all ran.

    Links are resolved just before a module; one without a value leaves the saved parameter and is logged.
    """
    for name in names:
        if cancelled():
            return False
        module = modules[name]
        values = dict(params.get(name, {}))
        for key, link in effective_links(module.links, (own_links or {}).get(name)).items():
            found = context.get(link)
            if found is None:
                log(f"{name}: {link} has no value; {key} stays as it is")
            else:
                values[key] = found
        if missing := [p["name"] for p in module.parameters if p.get("required") and _empty(values.get(p["name"]))]:
            log(f"{name}: missing {missing}")
            return False
        try:
            out = module.run(values, context) if len(signature(module.run).parameters) >= 2 else module.run(values)
        except Exception as e:
            log(f"{name}: {e}")
            return False
        context.put(name, out or {})
    return True
