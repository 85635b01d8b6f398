"""A compiler for a small sandboxed template language.

``{{ expression }}``, ``{% for x in expression %}``, ``{% if %} {% elif %}
{% else %}``, ``{% set x = expression %}`` and ``{% generation %} ...
{% endgeneration %}``, which marks what a model is trained on; a dash at a
brace strips white space on its side, ``{# ... #}`` is a comment. Expressions
know strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` (keys
of mappings only), ``loop.first/last/index/index0``, ``== != < > <= >= in``,
``+ ~``, ``and or not``, parentheses and filters. Templates are parsed into a
syntax tree, constants are folded, and the tree becomes Python closures.
Nothing of Python can be reached from a template.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|,=]))""", re.S)
TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: _str(x).strip(), "upper": lambda x: _str(x).upper(), "lower": lambda x: _str(x).lower(), "capitalize": lambda x: _str(x).capitalize(), "length": len, "string": lambda x: _str(x)}


class TemplateError(ValueError):
    """A template that can't be parsed, or a value that it can't use."""


def _str(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


@dataclass(frozen=True)
class Node:
    """A node of the syntax tree: kind, plain values, children."""

    kind: str
    value: Any = None
    kids: tuple = ()


class _Parser:
    def __init__(self, source: str, filters: dict):
        self.filters, self.parts, self.at = filters, [], 0
        strip = False
        for p in TAG.split(source):
            if TAG.fullmatch(p):
                if self.parts and self.parts[-1][0] == "text" and p[2] == "-":
                    self.parts[-1] = ("text", self.parts[-1][1].rstrip())
                strip = p[-3] == "-"
                if p[1] != "#":
                    self.parts.append(("out" if p[1] == "{" else "tag", p[2:-2].strip("-").strip()))
            elif p:
                self.parts.append(("text", p.lstrip() if strip else p))
                strip = False

    # statements
    def block(self, ends: tuple[str, ...]) -> Node:
        kids = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            if kind == "tag" and word in ends:
                return Node("block", None, tuple(kids))
            self.at += 1
            if kind == "text":
                kids.append(Node("const", body))
            elif kind == "out":
                kids.append(self.expression(body))
            else:
                kids.append(self.statement(word, body[len(word) :].strip()))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return Node("block", None, tuple(kids))

    def close(self, *ends: str) -> tuple[str, str]:
        word, _, rest = self.parts[self.at][1].partition(" ")
        if word not in ends:
            raise TemplateError(f"{word} where {' or '.join(ends)} was expected")
        self.at += 1
        return word, rest.strip()

    def statement(self, word: str, rest: str) -> Node:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            body = self.block(("endfor",))
            self.close("endfor")
            return Node("for", m[1], (self.expression(m[2]), body))
        if word == "if":
            cases, cond, tail = [], self.expression(rest), Node("block")
            while True:
                body = self.block(("elif", "else", "endif"))
                cases.append((cond, body))
                end, more = self.close("elif", "else", "endif")
                if end == "elif":
                    cond = self.expression(more)
                    continue
                if end == "else":
                    tail = self.block(("endif",))
                    self.close("endif")
                break
            for cond, body in reversed(cases):
                tail = Node("if", None, (cond, body, tail))
            return tail
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set {rest}")
            return Node("set", m[1], (self.expression(m[2]),))
        if word == "generation":
            body = self.block(("endgeneration",))
            self.close("endgeneration")
            return Node("generation", None, (body,))
        raise TemplateError(f"unknown statement {word!r}")

    # expressions
    def expression(self, text: str) -> Node:
        self.toks, i = [], 0
        while text[i:].strip():
            m = TOKEN.match(text, i)
            if not m:
                raise TemplateError(f"can't read {text[i:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()
        self.toks.append(("end", ""))
        self.i = 0
        node = self.either()
        if self.toks[self.i][0] != "end":
            raise TemplateError(f"{self.toks[self.i][1]!r} is left over in {text!r}")
        return node

    def take(self, *values: str) -> str | None:
        kind, v = self.toks[self.i]
        if kind != "str" and v in values:
            self.i += 1
            return v
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, {self.toks[self.i][1]!r} found")

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", None, (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.take("and"):
            node = Node("and", None, (node, self.negation()))
        return node

    def negation(self) -> Node:
        return Node("not", None, (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        while op := self.take(*COMPARE, "in"):
            node = Node("in" if op == "in" else "compare", op, (node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.postfix()
        while op := self.take("+", "~"):
            node = Node("add" if op == "+" else "concat", None, (node, self.postfix()))
        return node

    def postfix(self) -> Node:
        node = self.atom()
        while op := self.take(".", "[", "|"):
            if op == "[":
                node = Node("get", None, (node, self.either()))
                self.need("]")
                continue
            kind, name = self.toks[self.i]
            if kind != "name":
                raise TemplateError(f"a name expected after {op!r}")
            self.i += 1
            if op == "|" and name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            node = Node("filter", name, (node,)) if op == "|" else Node("get", None, (node, Node("const", name)))
        return node

    def atom(self) -> Node:
        kind, v = self.toks[self.i]
        self.i += 1
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1], flags=re.S))
        if kind == "int":
            return Node("const", int(v))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Node("const", fixed[v.lower()]) if v.lower() in fixed else Node("name", v)
        if v == "(":
            node = self.either()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str, filters: dict | None = None) -> Node:
    """The syntax tree of a template."""
    return _Parser(source, FILTERS | (filters or {})).block(())


def fold(node: Node, filters: dict | None = None) -> Node:
    """The tree with constant expressions computed, dead branches gone and neighbouring text joined."""
    known = FILTERS | (filters or {})
    kids = tuple(fold(k, filters) for k in node.kids)
    const = bool(kids) and all(k.kind == "const" for k in kids)
    if node.kind == "if" and kids[0].kind == "const":
        return kids[1] if kids[0].value else kids[2]
    if node.kind == "block":
        flat: list[Node] = []
        for k in kids:
            for x in k.kids if k.kind == "block" else (k,):
                if x.kind == "const" and flat and flat[-1].kind == "const":
                    flat[-1] = Node("const", _str(flat[-1].value) + _str(x.value))
                elif x.kind != "const" or _str(x.value):
                    flat.append(x)
        return Node("block", None, tuple(flat))
    if const and node.kind in ("or", "and", "not", "compare", "in", "add", "concat", "filter"):
        return Node("const", _value(Node(node.kind, node.value, kids), known)({}))
    return Node(node.kind, node.value, kids)


def _value(node: Node, filters: dict) -> Callable[[dict], Any]:
    """A closure that computes an expression in an environment."""
    v = node.value
    f = [_value(k, filters) for k in node.kids]
    if node.kind == "const":
        return lambda env: v
    if node.kind == "name":
        return lambda env: env.get(v)
    if node.kind == "get":

        def get(env, a=f[0], b=f[1]):
            x = a(env)
            return x.get(b(env)) if isinstance(x, dict) else None

        return get
    a, b = (f + [None, None])[:2]
    if node.kind == "or":
        return lambda env: a(env) or b(env)
    if node.kind == "and":
        return lambda env: a(env) and b(env)
    if node.kind == "not":
        return lambda env: not a(env)
    if node.kind == "compare":
        op = COMPARE[v]
        return lambda env: op(a(env), b(env))
    if node.kind == "in":
        return lambda env: a(env) in (b(env) or ())
    if node.kind == "add":

        def add(env):
            x, y = a(env), b(env)
            return x + y if isinstance(x, int) and isinstance(y, int) else _str(x) + _str(y)

        return add
    if node.kind == "concat":
        return lambda env: _str(a(env)) + _str(b(env))
    if node.kind == "filter":
        g = filters[v]
        return lambda env: g(a(env))
    raise TemplateError(f"{node.kind} is no expression")


def _looked_ahead(items: Iterable) -> Iterator[tuple[int, Any, bool]]:
    """Items with their place and whether they are the last; holds one item only."""
    it = iter(items)
    for held in it:
        i = 0
        for x in it:
            yield i, held, False
            held, i = x, i + 1
        yield i, held, True


Pieces = Callable[[dict], Iterator[tuple[str, bool]]]


def _action(node: Node, filters: dict, marked: bool) -> Pieces:
    """A closure that yields what a statement renders, with the generation mark."""
    v = node.value
    if node.kind == "block":
        steps = [_action(k, filters, marked) for k in node.kids]

        def block(env):
            for s in steps:
                yield from s(env)

        return block
    if node.kind == "for":
        items, body = _value(node.kids[0], filters), _action(node.kids[1], filters, marked)

        def loop(env):
            inner = dict(env)
            for i, x, last in _looked_ahead(items(env) or ()):
                inner[v] = x
                inner["loop"] = {"first": i == 0, "last": last, "index": i + 1, "index0": i}
                yield from body(inner)

        return loop
    if node.kind == "if":
        cond, yes, no = _value(node.kids[0], filters), _action(node.kids[1], filters, marked), _action(node.kids[2], filters, marked)
        return lambda env: (yes if cond(env) else no)(env)
    if node.kind == "set":
        value = _value(node.kids[0], filters)

        def put(env):
            env[v] = value(env)
            yield from ()

        return put
    if node.kind == "generation":
        return _action(node.kids[0], filters, True)
    value = _value(node, filters)

    def out(env):
        yield _str(value(env)), marked

    return out


class Template:
    """A compiled template; ``pieces`` yields text and its generation mark as it comes."""

    def __init__(self, source: str, filters: dict | None = None):
        self.tree = fold(parse(source, filters), filters)
        self._run = _action(self.tree, FILTERS | (filters or {}), False)

    def pieces(self, env: dict) -> Iterator[tuple[str, bool]]:
        return self._run(dict(env))

    def text(self, **env) -> str:
        return "".join(s for s, _ in self.pieces(env))
