"""Compiler of a small sandboxed template language to Python closures.

``{{ expression }}``, ``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set name = expression %}`` and ``{% generation %}`` (its output is what a
model learns to write).  Expressions: literals, names, ``a.b`` and ``a[b]`` on
mappings and lists only, ``== != in``, ``and or not``, ``~`` (join as text) and
named filters.  There are no calls and no Python attributes, so a template can
reach nothing but the values it is given and the filters listed here.

``compile_template`` parses to a syntax tree, folds constants (expressions,
branches, neighbouring output) and returns ``render(**values) -> (text, spans)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template is not valid, or asks for a value that it was not given."""


# ── Escapes ───────────────────────────────────────────────────────────────
def escape(text: str) -> str:
    """Reversible: the result holds no ``<|`` and every backslash in it starts an escape."""
    return text.replace("\\", "\\\\").replace("<|", "\\l")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


_BACK = {"\\": "\\", "l": "<|", "n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)), "escape_line": lambda v: escape_line(_text(v)), "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": len,
}


# ── Syntax tree ───────────────────────────────────────────────────────────
@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Emit:
    value: Any


@dataclass
class Block:
    body: list = field(default_factory=list)


@dataclass
class For:
    name: str
    items: Any
    body: Block


@dataclass
class If:
    test: Any
    then: Block
    other: Block


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: Block


_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|.()\[\]]))""", re.S)
_CONSTS = {"true": True, "false": False, "none": None}
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class _Parser:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.items, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next_is(self, *values: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def take(self, kind: str) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self):
        out = self.either()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.next_is("or"):
            out = Op("or", [out, self.both()])
        return out

    def both(self):
        out = self.negated()
        while self.next_is("and"):
            out = Op("and", [out, self.negated()])
        return out

    def negated(self):
        return Op("not", [self.negated()]) if self.next_is("not") else self.compared()

    def compared(self):
        out = self.joined()
        while kind := self.next_is("==", "!=", "in"):
            out = Op(kind, [out, self.joined()])
        return out

    def joined(self):
        out = self.filtered()
        while self.next_is("~"):
            out = Op("~", [out, self.filtered()])
        return out

    def filtered(self):
        out = self.path()
        while self.next_is("|"):
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Op("filter", [Const(name), out])
        return out

    def path(self):
        out = self.atom()
        while kind := self.next_is(".", "["):
            key = Const(self.take("name")) if kind == "." else self.either()
            if kind == "[" and not self.next_is("]"):
                raise TemplateError("] is missing")
            out = Op("get", [out, key])
        return out

    def atom(self):
        if self.next_is("("):
            out = self.either()
            if not self.next_is(")"):
                raise TemplateError(") is missing")
            return out
        if self.at >= len(self.items):
            raise TemplateError("a value is missing")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            return Const(_CONSTS[value]) if value in _CONSTS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> Block:
    """The syntax tree of a template."""
    root = Block()
    stack: list[tuple[str, Block, If | None]] = [("", root, None)]
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", template, flags=re.S)
    for i, piece in enumerate(pieces):
        body = stack[-1][1].body
        if i % 2 == 0:
            if i and pieces[i - 1].endswith(("-%}", "-}}")):
                piece = piece.lstrip()
            if i + 1 < len(pieces) and pieces[i + 1].startswith(("{%-", "{{-")):
                piece = piece.rstrip()
            if piece:
                body.append(Emit(Const(piece)))
            continue
        inner = piece[2:-2].removeprefix("-").removesuffix("-").strip()
        if piece[1] == "#":
            continue
        if piece[1] == "{":
            body.append(Emit(_Parser(inner).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError("for x in list")
            node = For(m[1], _Parser(m[2]).whole(), Block())
            body.append(node)
            stack.append(("for", node.body, None))
        elif word == "if":
            node = If(_Parser(rest).whole(), Block(), Block())
            body.append(node)
            stack.append(("if", node.then, node))
        elif word in ("elif", "else") and stack[-1][0] == "if" and stack[-1][2] is not None:
            top = stack.pop()[2]
            if word == "else":
                stack.append(("if", top.other, None))
            else:
                node = If(_Parser(rest).whole(), Block(), Block())
                top.other.body.append(node)
                stack.append(("if", node.then, node))
        elif word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.*)", rest, re.S)
            if not m:
                raise TemplateError("set name = value")
            body.append(Set(m[1], _Parser(m[2]).whole()))
        elif word == "generation":
            if any(kind == "generation" for kind, _, _ in stack):
                raise TemplateError("generation inside generation")
            node = Generation(Block())
            body.append(node)
            stack.append(("generation", node.body, None))
        elif word.startswith("end") and len(stack) > 1 and word[3:] == stack[-1][0]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {{% {inner} %}}")
    if len(stack) > 1:
        raise TemplateError(f"end{stack[-1][0]} is missing")
    return root


# ── Constant folding ──────────────────────────────────────────────────────
def fold(node):
    """The same tree with constant expressions computed, dead branches gone and neighbouring output joined."""
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if all(isinstance(a, Const) for a in args) and node.kind != "get":
            return Const(_expression(Op(node.kind, args))({}))
        if node.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        return Op(node.kind, args)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.items), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        test, then, other = fold(node.test), fold(node.then), fold(node.other)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, Block):
        out: list = []
        for child in map(fold, node.body):
            for x in child.body if isinstance(child, Block) else [child]:
                if isinstance(x, Emit) and isinstance(x.value, Const):
                    text = _text(x.value.value)
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(out[-1].value.value + text))
                    elif text:
                        out.append(Emit(Const(text)))
                else:
                    out.append(x)
        return Block(out)
    return node


# ── Closures ──────────────────────────────────────────────────────────────
def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _get(box: Any, key: Any) -> Any:
    if isinstance(box, dict) and key in box:
        return box[key]
    if isinstance(box, (list, tuple)) and isinstance(key, int) and -len(box) <= key < len(box):
        return box[key]
    raise TemplateError(f"no value {key!r}")


def _expression(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"no value {name!r}")
            return env[name]
        return look
    if node.kind == "filter":
        use, arg = FILTERS[node.args[0].value], _expression(node.args[1])
        return lambda env: use(arg(env))
    args = [_expression(a) for a in node.args]
    a, b = args[0], args[-1]
    return {
        "get": lambda env: _get(a(env), b(env)), "~": lambda env: _text(a(env)) + _text(b(env)),
        "==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "in": lambda env: a(env) in b(env),
        "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env), "not": lambda env: not a(env),
    }[node.kind]


class _Out:
    """The text so far, and the spans of it that are generated."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _statement(node) -> Callable[[dict, _Out], None]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda env, out: out.put(text)
        value = _expression(node.value)
        return lambda env, out: out.put(_text(value(env)))
    if isinstance(node, Block):
        steps = [_statement(x) for x in node.body]

        def run(env: dict, out: _Out) -> None:
            for step in steps:
                step(env, out)
        return run
    if isinstance(node, If):
        test, then, other = _expression(node.test), _statement(node.then), _statement(node.other)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value)

        def put(env: dict, out: _Out) -> None:
            env[name] = value(env)
        return put
    if isinstance(node, Generation):
        body = _statement(node.body)

        def mark(env: dict, out: _Out) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))
        return mark
    name, items, body = node.name, _expression(node.items), _statement(node.body)

    def each(env: dict, out: _Out) -> None:
        values = items(env)
        if not isinstance(values, (list, tuple)):
            raise TemplateError("for needs a list")
        for i, value in enumerate(values):
            body({**env, name: value, "loop": {"index0": i, "first": i == 0, "last": i + 1 == len(values)}}, out)
    return each


def compile_template(template: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    run = _statement(fold(parse(template)))

    def render(**values: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(values), out)
        return "".join(out.parts), out.spans
    return render
