"""Functions by name.

A scalar function is registered with its signature, e.g. ``substr(target: string,
start: integer, count?: integer): string``, and a builder from arguments to a Column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from lanternql.errors import QueryError


@dataclass(frozen=True)
class Arg:
    """An argument: its column, its type, and its value where it is a literal."""

    col: Column
    type: T.DataType
    value: object = None
    is_literal: bool = False


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    optional: bool = False
    variadic: bool = False


@dataclass(frozen=True)
class Function:
    name: str
    kind: str  # scalar, aggregate, table, formatter, sink
    signature: str
    parameters: tuple[Parameter, ...]
    build: Callable
    safe: bool = True
    description: str = ""


SIGNATURE = re.compile(r'^\s*\[?"?(?P<name>\w+)"?\]?\s*\((?P<args>.*)\)\s*(?::\s*(?P<type>.+?))?\s*$', re.S)
PARAMETER = re.compile(r'^(?P<rest>\.\.\.)?"?(?P<name>\w+)"?(?P<opt>\?)?\s*:\s*(?P<type>[\w<>]+(?:\[\])?)\s*(?:(?::?=|default)\s*(?P<default>.+))?$', re.I)


def parse_signature(text: str) -> tuple[str, tuple[Parameter, ...], str | None]:
    m = SIGNATURE.match(text)
    if not m:
        raise QueryError(f"not a function signature: {text!r}")
    parameters = []
    for part in filter(None, (p.strip() for p in m["args"].split(","))):
        p = PARAMETER.match(part)
        if not p:
            raise QueryError(f"not a parameter: {part!r}")
        parameters.append(Parameter(p["name"].lower(), p["type"].lower(), bool(p["opt"]) or p["default"] is not None, bool(p["rest"])))
    return m["name"].lower(), tuple(parameters), m["type"]


class Registry:
    def __init__(self, parent: Registry | None = None):
        self.parent = parent
        self.functions: dict[str, Function] = {}

    def add(self, signature: str, kind: str, build: Callable, safe: bool = True, description: str = "", also: tuple[str, ...] = ()) -> None:
        name, parameters, _ = parse_signature(signature)
        for n in (name, *also):
            self.functions[n] = Function(n, kind, signature, parameters, build, safe, description)

    def find(self, name: str) -> Function | None:
        return self.functions.get(name.lower()) or (self.parent.find(name) if self.parent else None)

    def all(self) -> list[Function]:
        mine = dict(self.functions)
        for f in self.parent.all() if self.parent else []:
            mine.setdefault(f.name, f)
        return sorted(mine.values(), key=lambda f: f.name)


def arrange(function: Function, args: list, named: dict[str, object]) -> list:
    """Positional and named arguments in the order of the parameters; None where left out."""
    out = list(args)
    if not any(p.variadic for p in function.parameters) and len(args) > len(function.parameters):
        raise QueryError(f"{function.name}: too many arguments")
    for p in function.parameters[len(args) :]:
        if p.name in named:
            out.append(named.pop(p.name))
        elif p.optional or p.variadic:
            out.append(None)
        else:
            raise QueryError(f"{function.name}: argument {p.name} is missing")
    if named:
        raise QueryError(f"{function.name}: no parameter {', '.join(named)}")
    while out and out[-1] is None:
        out.pop()
    return out
