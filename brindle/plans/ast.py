"""Expression trees: frozen dataclasses, printed as text that parses back to the same tree."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import types as T

from brindle.functions.types import parse_type, type_text


class Node:
    def children(self) -> Iterator[Node]:
        def walk(v):
            if isinstance(v, Node):
                yield v
            elif isinstance(v, tuple):
                for x in v:
                    yield from walk(x)

        for f in fields(self):
            yield from walk(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()

    def columns(self) -> list[str]:
        return list(dict.fromkeys(n.name for n in self.walk() if isinstance(n, Column)))

    def parameters(self) -> list[str]:
        return list(dict.fromkeys(n.name for n in self.walk() if isinstance(n, Parameter)))

    def attributes(self) -> list[str]:
        return list(dict.fromkeys(n.name for n in self.walk() if isinstance(n, Attribute)))

    def conjuncts(self) -> list[Node]:
        return [c for x in self.items for c in x.conjuncts()] if isinstance(self, And) else [self]

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children()), default=0)

    def __str__(self) -> str:
        return text(self)


@dataclass(frozen=True)
class Literal(Node):
    value: object
    type: T.DataType | None = None


@dataclass(frozen=True)
class Column(Node):
    name: str


@dataclass(frozen=True)
class Path(Node):
    base: Node
    steps: tuple  # ("field", name) | ("index", int) | ("key", text)


@dataclass(frozen=True)
class Attribute(Node):
    name: str
    argument: str | None = None


@dataclass(frozen=True)
class Parameter(Node):
    name: str


@dataclass(frozen=True)
class And(Node):
    items: tuple


@dataclass(frozen=True)
class Or(Node):
    items: tuple


@dataclass(frozen=True)
class Not(Node):
    item: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str  # = <> < <= > >= distinct same
    left: Node
    right: Node


@dataclass(frozen=True)
class In(Node):
    item: Node
    options: tuple
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    item: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Node):
    item: Node
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    item: Node
    pattern: str
    escape: str | None = None
    fold: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Glob(Node):
    item: Node
    pattern: str


@dataclass(frozen=True)
class Arithmetic(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negate(Node):
    item: Node


@dataclass(frozen=True)
class Function(Node):
    name: str
    args: tuple


@dataclass(frozen=True)
class Cast(Node):
    item: Node
    type: T.DataType
    safe: bool = False


@dataclass(frozen=True)
class Case(Node):
    branches: tuple  # of (when, then)
    otherwise: Node | None = None


@dataclass(frozen=True)
class Struct(Node):
    items: tuple  # of (name, node)


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple


@dataclass(frozen=True)
class MapOf(Node):
    items: tuple  # of (key, value)


@dataclass(frozen=True)
class Projection:
    expression: Node | None  # None: *
    alias: str | None = None

    @property
    def name(self) -> str:
        e = self.expression
        if self.alias:
            return self.alias
        if isinstance(e, Column):
            return e.name
        if isinstance(e, Path) and e.steps[-1][0] != "index":
            return str(e.steps[-1][1])
        return text(e)


@dataclass(frozen=True)
class Order:
    expression: Node
    descending: bool = False
    nulls_first: bool | None = None  # None: last ascending, first descending


@dataclass(frozen=True)
class Statement:
    projections: tuple = (Projection(None),)
    where: Node | None = None
    order: tuple = ()
    limit: int | None = None

    def __str__(self) -> str:
        out = "select " + ", ".join("*" if p.expression is None else text(p.expression) + (f" as {_name(p.alias)}" if p.alias else "") for p in self.projections)
        if self.where is not None:
            out += f" where {text(self.where)}"
        if self.order:
            out += " order by " + ", ".join(text(o.expression) + (" desc" if o.descending else "") + ("" if o.nulls_first is None else " nulls first" if o.nulls_first else " nulls last") for o in self.order)
        return out + (f" limit {self.limit}" if self.limit is not None else "")


_WORDS = set("and or not in between is null like ilike escape glob case when then else end cast try_cast as select where order by asc desc nulls first last limit true false distinct from struct date32".split())


def _name(n: str) -> str:
    return n if n.isidentifier() and n.isascii() and n.lower() not in _WORDS else '"' + n.replace('"', '""') + '"'


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rank(n: Node) -> int:
    for k, kinds in enumerate((Or, And, Not, (Compare, In, Between, IsNull, Like, Glob))):
        if isinstance(n, kinds):
            return k
    if isinstance(n, Arithmetic):
        return 4 if n.op in "+-" else 5
    return 6 if isinstance(n, Negate) else 7


def text(n: Node) -> str:
    def sub(x: Node, least: int) -> str:
        return text(x) if _rank(x) >= least else f"({text(x)})"

    no = "not " if getattr(n, "negated", False) else ""
    match n:
        case Literal(v, t):
            if v is None:
                return "null" if t is None else f"{type_text(t)} null"
            if isinstance(v, bool):
                return str(v).lower()
            if t is not None:
                return f"{type_text(t)} {_q(str(v))}"
            return _q(v) if isinstance(v, str) else repr(v)
        case Column(name):
            return _name(name)
        case Path(base, steps):
            return sub(base, 7) + "".join(f".{_name(v)}" if k == "field" else f"[{v}]" if k == "index" else f"[{_q(v)}]" for k, v in steps)
        case Attribute(name, arg):
            return f"&holder.{name}" + (f"[{_q(arg)}]" if arg is not None else "")
        case Parameter(name):
            return f":{name}"
        case And(items):
            return " and ".join(sub(x, 2) for x in items) or "true"
        case Or(items):
            return " or ".join(sub(x, 1) for x in items) or "false"
        case Not(x):
            return f"not {sub(x, 2)}"
        case Compare(op, a, b):
            return f"{sub(a, 4)} {dict(distinct='is distinct from', same='is not distinct from').get(op, op)} {sub(b, 4)}"
        case In(x, options):
            return f"{sub(x, 4)} {no}in ({', '.join(map(text, options))})"
        case Between(x, a, b):
            return f"{sub(x, 4)} {no}between {sub(a, 4)} and {sub(b, 4)}"
        case IsNull(x):
            return f"{sub(x, 4)} is {no}null"
        case Like(x, pattern, escape, fold):
            return f"{sub(x, 4)} {no}{'ilike' if fold else 'like'} {_q(pattern)}" + (f" escape {_q(escape)}" if escape else "")
        case Glob(x, pattern):
            return f"{sub(x, 4)} glob {_q(pattern)}"
        case Arithmetic(op, a, b):
            r = 4 if op in "+-" else 5
            return f"{sub(a, r)} {op} {sub(b, r + 1)}"
        case Negate(x):
            return f"-{sub(x, 7)}"
        case Function(name, args):
            return f"{name}({', '.join(map(text, args))})"
        case Cast(x, t, safe):
            return f"{'try_cast' if safe else 'cast'}({text(x)} as {type_text(t)})"
        case Case(branches, otherwise):
            return "case " + " ".join(f"when {text(a)} then {text(b)}" for a, b in branches) + (f" else {text(otherwise)}" if otherwise is not None else "") + " end"
        case Struct(items):
            return "struct(" + ", ".join(f"{text(x)} as {_name(k)}" for k, x in items) + ")"
        case ListOf(items):
            return "[" + ", ".join(map(text, items)) + "]"
        case MapOf(items):
            return "{" + ", ".join(f"{text(k)}: {text(v)}" for k, v in items) + "}"
    raise TypeError(n)


def to_json(n) -> str:
    def enc(v):
        if isinstance(v, T.DataType):
            return {"type": type_text(v)}
        if is_dataclass(v):
            return {"node": type(v).__name__} | {f.name: enc(getattr(v, f.name)) for f in fields(v)}
        return {"tuple": [enc(x) for x in v]} if isinstance(v, tuple) else v

    return json.dumps(enc(n))


def from_json(raw: str):
    def dec(v):
        if isinstance(v, dict):
            if "type" in v and len(v) == 1:
                return parse_type(v["type"])
            if "tuple" in v:
                return tuple(map(dec, v["tuple"]))
            return globals()[v["node"]](**{k: dec(x) for k, x in v.items() if k != "node"})
        return v

    return dec(json.loads(raw))
