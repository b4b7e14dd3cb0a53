"""A compiler for a small sandboxed template language: text -> syntax tree -> folded tree -> Python closures.

Language: `{{ expression }}`, `{% for x in e %}`, `{% if e %} {% elif e %} {% else %}`, `{% set x = e %}`, `{% generation %} ... {% endgeneration %}` around what a model is to
produce, `{# notes #}`, and `-` beside a mark to strip the white space there. Expressions: strings, whole numbers, true, false, none, names, `a.b`, `a['b']`,
`not and or`, `== != < <= > >= in`, `+ - *` and `~` (joins as text), `x if c else y`, filters `e | name`, and `loop.index, index0, first, last` inside a loop.

Sandbox: a template sees only what `render` is given. Items are looked up in mappings alone, never as Python attributes; nothing is called but the filters named
here and those passed to `compile_template`; names with a leading underscore don't parse; templates are at most MOST_SOURCE characters and MOST_DEPTH deep.

Rendering yields (text, generated) pieces and takes the messages from any iterator, one ahead, so a conversation needn't fit into memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

MOST_SOURCE, MOST_DEPTH, MOST_VALUE = 100_000, 50, 1_000_000_000


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """op: an operator or `|filter`."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


MARKS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
LEXEMES = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~<>|.\[\]()=]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def lex(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = LEXEMES.match(source, at)
        if not m:
            raise TemplateError(f"unreadable expression: {source[at : at + 20]!r}")
        kind = m.lastgroup
        value: Any = m[kind]
        if kind == "num":
            value = int(value)
        elif kind == "str":
            value = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        elif kind == "name" and value.startswith("_"):
            raise TemplateError(f"name not allowed: {value}")
        out.append((kind, value))
        at = m.end()
    return out


class Expressions:
    """Recursive descent over one expression."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*",))

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters, self.depth = lex(source), 0, filters, 0

    def peek(self) -> Any:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("name", "op") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, not {self.peek()[1]!r}")

    def whole(self) -> Any:
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.peek()[1]!r}")
        return e

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        e = self.level(0)
        if self.take("if"):
            test = self.level(0)
            other = self.choice() if self.take("else") else Const(None)
            e = Apply("if", (test, e, other))
        self.depth -= 1
        return e

    def level(self, k: int) -> Any:
        if k == len(self.LEVELS):
            return self.suffixed()
        ops = self.LEVELS[k]
        if ops == ("not",):
            negated = 0
            while self.take("not"):
                negated += 1
            e = self.level(k + 1)
            return Apply("not", (e,)) if negated % 2 else Apply("not", (Apply("not", (e,)),)) if negated else e
        e = self.level(k + 1)
        while op := self.take(*ops):
            e = Apply(op, (e, self.level(k + 1)))
        return e

    def suffixed(self) -> Any:
        e = self.primary()
        while op := self.take(".", "[", "|"):
            if op == "[":
                e = Item(e, self.choice())
                self.need("]")
                continue
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError(f"expected a name after {op!r}")
            self.at += 1
            if op == ".":
                e = Item(e, Const(name))
            elif name in self.filters:
                e = Apply("|" + name, (e,))
            else:
                raise TemplateError(f"no such filter: {name}")
        return e

    def primary(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind in ("num", "str"):
            return Const(value)
        if kind == "name":
            return Const(WORDS[value]) if value in WORDS else Name(value)
        if (kind, value) == ("op", "("):
            e = self.choice()
            self.need(")")
            return e
        raise TemplateError(f"expected a value, not {value!r}")


def marks(source: str) -> list[tuple[str, str]]:
    """('text' | 'out' | 'tag', content) in order, stripped as the `-` say."""
    if len(source) > MOST_SOURCE:
        raise TemplateError("template too long")
    out, at, strip = [], 0, False

    def text(upto: int, strip_end: bool) -> None:
        t = source[at:upto]
        t = t.lstrip() if strip else t
        out.append(("text", t.rstrip() if strip_end else t))

    for m in MARKS.finditer(source):
        text(m.start(), "-" in (m[1], m[4], m[7]))
        if m[2] is not None:
            out.append(("out", m[2]))
        elif m[5] is not None:
            out.append(("tag", m[5].strip()))
        at, strip = m.end(), "-" in (m[3], m[6], m[8])
    text(len(source), False)
    return out


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    items, at = marks(source), 0

    def expression(text: str) -> Any:
        return Expressions(text, filters).whole()

    def name(text: str) -> str:
        if not re.fullmatch(r"[A-Za-z]\w*", text):
            raise TemplateError(f"not a name: {text!r}")
        return text

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal at
        if depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        body: list = []
        while at < len(items):
            kind, content = items[at]
            at += 1
            if kind == "text":
                body.append(Text(content))
                continue
            if kind == "out":
                body.append(Out(expression(content)))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(body), content
            if word == "for":
                m = re.fullmatch(r"(\S+)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad loop: {content}")
                inner, _ = block(("endfor",), depth + 1)
                body.append(For(name(m[1]), expression(m[2]), inner))
            elif word == "if":
                body.append(branch(rest, depth))
            elif word == "set":
                left, eq, right = rest.partition("=")
                if not eq:
                    raise TemplateError(f"bad set: {content}")
                body.append(Set(name(left.strip()), expression(right)))
            elif word == "generation":
                body.append(Generation(block(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"unknown tag: {content}")
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return tuple(body), ""

    def branch(test: str, depth: int) -> If:
        then, end = block(("elif", "else", "endif"), depth + 1)
        other: tuple = ()
        if end.startswith("elif"):
            other = (branch(end[4:], depth + 1),)
        elif end == "else":
            other, _ = block(("endif",), depth + 1)
        return If(expression(test), then, other)

    return block((), 0)[0]


def shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _times(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int) and abs(a * b) <= MOST_VALUE:
        return a * b
    raise TemplateError("only numbers are multiplied")


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: shown(a) + shown(b), "*": _times,
}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda v: shown(v).strip(), "upper": lambda v: shown(v).upper(), "lower": lambda v: shown(v).lower(), "length": len, "string": shown}


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with what is constant worked out: expressions, branches, neighbouring texts."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(x, filters) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Out):
        v = fold(node.value, filters)
        return Text(shown(v.value)) if isinstance(v, Const) else Out(v)
    if isinstance(node, If):
        test, then, other = fold(node.test, filters), fold(node.then, filters), fold(node.other, filters)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        if node.op in ("if", "and", "or") and isinstance(args[0], Const):
            chosen = args[0].value if node.op == "if" else None
            return (args[1] if chosen else args[2]) if node.op == "if" else args[bool(args[0].value) == (node.op == "and")]
        folded = Apply(node.op, args)
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(closure(folded, filters)({}))
            except Exception:  # noqa: BLE001  an expression that fails does so when it is rendered
                return folded
        return folded
    return node


def closure(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """An expression as a function of the names."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"unknown name: {name}")
            return env[name]

        return look
    if isinstance(node, Item):
        of, key = closure(node.of, filters), closure(node.key, filters)

        def item(env: dict) -> Any:
            held = of(env)
            if not isinstance(held, Mapping):
                raise TemplateError("only mappings have items")
            return held.get(key(env))

        return item
    op, args = node.op, [closure(a, filters) for a in node.args]
    if op[0] == "|":
        f, arg = filters[op[1:]], args[0]
        return lambda env: f(arg(env))
    if op == "not":
        return lambda env: not args[0](env)
    if op == "and":
        return lambda env: args[0](env) and args[1](env)
    if op == "or":
        return lambda env: args[0](env) or args[1](env)
    if op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    f, a, b = BINARY[op], *args
    return lambda env: f(a(env), b(env))


Pieces = Iterator[tuple[str, bool]]


def renderer(body: tuple, filters: Mapping[str, Callable], generated: bool = False) -> Callable[[dict], Pieces]:
    """Statements as a generator function of the names."""
    steps = [_step(x, filters, generated) for x in body]

    def run(env: dict) -> Pieces:
        for s in steps:
            yield from s(env)

    return run


def _step(node: Any, filters: Mapping[str, Callable], generated: bool) -> Callable[[dict], Pieces]:
    if isinstance(node, Text):
        piece = (node.text, generated)
        return lambda env: iter((piece,))
    if isinstance(node, Out):
        value = closure(node.value, filters)
        return lambda env: iter(((shown(value(env)), generated),))
    if isinstance(node, Generation):
        return renderer(node.body, filters, True)
    if isinstance(node, If):
        test, then, other = closure(node.test, filters), renderer(node.then, filters, generated), renderer(node.other, filters, generated)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Set):
        name, value = node.name, closure(node.value, filters)

        def put(env: dict) -> Pieces:
            env[name] = value(env)
            return iter(())

        return put
    name, over, body = node.name, closure(node.over, filters), renderer(node.body, filters, generated)

    def loop(env: dict) -> Pieces:
        items = over(env)
        if isinstance(items, (str, Mapping)):
            raise TemplateError("only lists are looped over")
        rest, k, end = iter(items), 0, object()
        here = next(rest, end)
        while here is not end:
            ahead = next(rest, end)
            yield from body({**env, name: here, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": ahead is end}})
            here, k = ahead, k + 1

    return loop


class Template:
    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        known = {**FILTERS, **(filters or {})}
        self.tree = fold(parse(source, known), known)
        self._run = renderer(self.tree, known)

    def render(self, messages: Iterable[Mapping[str, Any]], **names: Any) -> Pieces:
        """(text, whether it is generated) in order."""
        return self._run({"messages": messages, **names})


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Template:
    return Template(source, filters)
