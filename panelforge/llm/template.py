"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}            text of an expression
    {% for m in messages %} ... {% endfor %}
    {% if test %} ... {% elif test %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   text that is learned

Expressions: strings, integers, true, false, none, names, `a.field`,
`a | filter`, `+`, `==`, `!=`, `not`, `and`, `or`, brackets. Only names of the
context, fields of messages (role, text) and the loop (first, last, index0),
and the filters given to compile() can be reached; there are no calls,
subscripts or attributes of Python objects.

compile() parses to a syntax tree, folds constants (also tests that are
constant, and neighbouring literals) and builds one closure a node. Closures
yield (text, learned) parts, so that a conversation of any length is rendered
message by message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass


class TemplateError(ValueError):
    """The template can't be parsed, or reaches for what it may not."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Filtered:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Put:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (test, body); the test of else is Const(True)


@dataclass(frozen=True)
class Let:
    name: str
    value: object


@dataclass(frozen=True)
class Learned:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|+()=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
Filters = dict[str, Callable[[str], str]]


class _Expression:
    def __init__(self, source: str, filters: Filters):
        self.filters = filters
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            kind = ("string", "int", "name", "op")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] != "string" else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if not self.tokens or want is not None and self.peek() != want:
            raise TemplateError(f"expected {want or 'more'}")
        return self.tokens.pop(0)

    def whole(self) -> object:
        out = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return out

    def _chain(self, ops: tuple[str, ...], below: Callable[[], object]) -> object:
        out = below()
        while self.peek() in ops:
            op = self.take()[1]
            out = folded(Op(op, (out, below())))
        return out

    def either(self) -> object:
        return self._chain(("or",), lambda: self._chain(("and",), self.negated))

    def negated(self) -> object:
        if self.peek() == "not":
            self.take()
            return folded(Op("not", (self.negated(),)))
        return self._chain(("==", "!="), lambda: self._chain(("+",), self.filtered))

    def filtered(self) -> object:
        out = self.atom()
        while self.peek() in (".", "|"):
            op = self.take()[1]
            kind, name = self.take()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no such name {name!r}")
            if op == "|" and name not in self.filters:
                raise TemplateError(f"no such filter {name!r}")
            out = Field(out, name) if op == "." else folded(Filtered(out, name), self.filters)
        return out

    def atom(self) -> object:
        kind, x = self.take()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), x[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(x))
        if kind == "name":
            if x.startswith("_"):
                raise TemplateError(f"no such name {x!r}")
            return Const({"true": True, "false": False, "none": None}[x]) if x in ("true", "false", "none") else Name(x)
        if x == "(":
            out = self.either()
            self.take(")")
            return out
        raise TemplateError(f"unexpected {x!r}")


def _apply(op: str, args: list) -> object:
    if op == "not":
        return not args[0]
    a, b = args
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    return {"==": a == b, "!=": a != b, "and": a and b, "or": a or b}[op]


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def folded(node: object, filters: Filters | None = None) -> object:
    """The node, or its value if all it needs is constant."""
    if isinstance(node, Op) and all(isinstance(a, Const) for a in node.args):
        return Const(_apply(node.op, [a.value for a in node.args]))
    if isinstance(node, Filtered) and isinstance(node.of, Const) and filters:
        return Const(filters[node.name](_text(node.of.value)))
    return node


def parse(source: str, filters: Filters) -> tuple:
    """The syntax tree, with constants folded."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts += [("text", source[at : m.start()])] if m.start() > at else []
        parts.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts += [("text", source[at:])] if at < len(source) else []
    parts.reverse()

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        out: list = []
        while parts:
            kind, x = parts.pop()
            if kind == "text":
                out.append(Put(Const(x)))
                continue
            if kind == "put":
                out.append(Put(_Expression(x, filters).whole()))
                continue
            word, _, rest = x.partition(" ")
            if word in ends:
                return merged(out), x
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*) in (.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad loop {x!r}")
                inner, _ = body(("endfor",))
                out.append(For(m[1], _Expression(m[2], filters).whole(), inner))
            elif word == "if":
                arms, end = [], x
                while not end.startswith("endif"):
                    test = Const(True) if end == "else" else _Expression(end.partition(" ")[2], filters).whole()
                    inner, end = body(("elif", "else", "endif"))
                    arms.append((test, inner))
                out += pruned(arms)
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"bad set {x!r}")
                out.append(Let(name.strip(), _Expression(value, filters).whole()))
            elif word == "generation":
                inner, _ = body(("endgeneration",))
                out.append(Learned(inner))
            else:
                raise TemplateError(f"unknown tag {x!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return merged(out), ""

    return body(())[0]


def pruned(arms: list) -> list:
    """Arms whose test is constant: false ones go, nothing follows a true one."""
    left = []
    for test, inner in arms:
        if isinstance(test, Const) and not test.value:
            continue
        left.append((test, inner))
        if isinstance(test, Const):
            break
    if not left:
        return []
    return list(left[0][1]) if isinstance(left[0][0], Const) else [If(tuple(left))]


def merged(nodes: list) -> tuple:
    """Neighbouring literals as one."""
    out: list = []
    for n in nodes:
        if isinstance(n, Put) and isinstance(n.value, Const):
            if out and isinstance(out[-1], Put) and isinstance(out[-1].value, Const):
                out[-1] = Put(Const(_text(out[-1].value.value) + _text(n.value.value)))
                continue
        out.append(n)
    return tuple(out)


Part = tuple[str, bool]
Scope = dict[str, object]


def _value(node: object, filters: Filters) -> Callable[[Scope], object]:
    if isinstance(node, Const):
        return lambda s, v=node.value: v
    if isinstance(node, Name):
        return lambda s, n=node.name: s.get(n)
    if isinstance(node, Field):
        of = _value(node.of, filters)

        def field(s: Scope, n: str = node.name) -> object:
            x = of(s)
            if not isinstance(x, dict):  # only mappings that the caller gave have fields
                raise TemplateError(f"no field {n!r} here")
            return x.get(n)

        return field
    if isinstance(node, Filtered):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda s: f(_text(of(s)))
    args = [_value(a, filters) for a in node.args]
    if node.op == "and":
        return lambda s: args[0](s) and args[1](s)
    if node.op == "or":
        return lambda s: args[0](s) or args[1](s)
    return lambda s, op=node.op: _apply(op, [a(s) for a in args])


def _render(node: object, filters: Filters) -> Callable[[Scope, bool], Iterator[Part]]:
    if isinstance(node, Put):
        value = _value(node.value, filters)

        def put(s: Scope, learned: bool) -> Iterator[Part]:
            yield _text(value(s)), learned

        return put
    if isinstance(node, Let):
        value = _value(node.value, filters)

        def let(s: Scope, learned: bool) -> Iterator[Part]:
            s[node.name] = value(s)
            return iter(())

        return let
    if isinstance(node, Learned):
        inner = _body(node.body, filters)
        return lambda s, learned: inner(s, True)
    if isinstance(node, If):
        arms = [(_value(t, filters), _body(b, filters)) for t, b in node.arms]

        def choose(s: Scope, learned: bool) -> Iterator[Part]:
            for test, inner in arms:
                if test(s):
                    return inner(s, learned)
            return iter(())

        return choose
    over, inner = _value(node.over, filters), _body(node.body, filters)

    def loop(s: Scope, learned: bool) -> Iterator[Part]:
        rows = iter(over(s) or ())
        now = next(rows, None)
        index = 0
        while now is not None:
            after = next(rows, None)
            own = s | {node.name: now, "loop": {"first": index == 0, "last": after is None, "index0": index}}
            yield from inner(own, learned)
            now, index = after, index + 1

    return loop


def _body(nodes: tuple, filters: Filters) -> Callable[[Scope, bool], Iterator[Part]]:
    steps = [_render(n, filters) for n in nodes]

    def run(s: Scope, learned: bool) -> Iterator[Part]:
        for step in steps:
            yield from step(s, learned)

    return run


def compile(source: str, filters: Filters) -> Callable[[Iterable[dict]], Iterator[Part]]:
    """A function from messages (role, text) to parts (text, learned)."""
    run = _body(parse(source, filters), filters)
    return lambda messages, **context: run(context | {"messages": messages}, False)
