"""A small sandboxed template language for chats: parsed to a syntax tree, constants folded, compiled to Python closures.

    {{ expression }}   {# comment #}   {% set name = expression %}
    {% for m in messages %} ... {% endfor %}   {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   what a model is trained on

Expressions: strings, numbers, true, false, none, names, ``a.b`` and ``a['b']`` (keys of mappings only, never Python attributes),
``+`` (text join), ``==``, ``!=``, ``and``, ``or``, ``not``, brackets and filters ``x | name`` or ``x | name('text')`` from a fixed list.
``loop.index``, ``loop.index0``, ``loop.first`` and ``loop.last`` stand in loops. Rendering is lazy: a loop draws one
message at a time, so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Piece = tuple[str, bool | None]  # a text and whether it is generated; None after each turn of an outer loop
TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.+|()\[\],=]))", re.S)
TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)


class TemplateError(ValueError):
    """The template is not in the language."""


def controls_pattern(controls: Iterable[str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, ["\\", *controls])))


def unescape(text: str) -> str:
    """The text from which ``escape`` made ``text``."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class _Parser:
    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        here = 0
        for m in TAG.finditer(source):
            self.parts.append(("text", source[here : m.start()]))
            if m[1] is not None:
                self.parts.append(("out", m[1]))
            elif m[2] is not None:
                self.parts.append(("tag", m[2].strip()))
            here = m.end()
        self.parts.append(("text", source[here:]))
        self.at = 0

    def block(self, ends: tuple[str, ...]) -> tuple[list, str]:
        """Nodes up to one of the tags ``ends``, and that tag."""
        nodes = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes += [("text", body)] if body else []
            elif kind == "out":
                nodes.append(("out", _Expression(body).whole()))
            else:
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return nodes, body
                nodes.append(self.tag(word, body[len(word) :].strip()))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return nodes, ""

    def tag(self, word: str, rest: str) -> tuple:
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return "for", m[1], _Expression(m[2]).whole(), self.block(("endfor",))[0]
        if word == "if":
            arms, test = [], _Expression(rest).whole()
            while True:
                body, end = self.block(("elif", "else", "endif"))
                arms.append((test, body))
                if end == "endif":
                    return "if", arms
                test = _Expression(end[4:]).whole() if end.startswith("elif") else ("const", True)
        if word == "generation" and not rest:
            return "generation", self.block(("endgeneration",))[0]
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.S)):
            return "set", m[1], _Expression(m[2]).whole()
        raise TemplateError(f"tag {word} {rest}")


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.tokens, here, text = [], 0, text.strip()
        while here < len(text):
            if not (m := TOKEN.match(text, here)):
                raise TemplateError(f"expression {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            here = m.end()
        self.at = 0

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]}")
        return node

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and (t := self.tokens[self.at][1]) in texts:
            self.at += 1
            return t
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"no {text}")

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        node = self.joined()
        while op := self.take("==", "!="):
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.primary()
        while self.take("|"):
            name, arg = self.name(), ("const", None)
            if self.take("("):
                arg = self.either()
                self.need(")")
            node = ("filter", name, node, arg)
        return node

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        if self.take("("):
            node = self.either()
            self.need(")")
        else:
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "str":
                node = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
            elif kind == "num":
                node = ("const", int(text))
            elif kind == "name":
                node = ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
            else:
                raise TemplateError(f"unexpected {text}")
        while True:
            if self.take("."):
                node = ("get", node, ("const", self.name()))
            elif self.take("["):
                node = ("get", node, self.either())
                self.need("]")
            else:
                return node


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else ("true" if x else "false") if isinstance(x, bool) else str(x)


class Template:
    """A compiled template; ``controls`` are the strings that the filter escape guards against."""

    def __init__(self, source: str, controls: Iterable[str] = ()):
        guard = controls_pattern(controls)
        self.filters: dict[str, Callable] = {
            "escape": lambda x, more: (controls_pattern([*controls, *_text(more)]) if more else guard).sub(lambda m: "\\" + m[0], _text(x)),
            "trim": lambda x, _: _text(x).strip(), "upper": lambda x, _: _text(x).upper(), "lower": lambda x, _: _text(x).lower(), "default": lambda x, other: other if x is None else x,
        }
        self.tree = self._fold_block(_Parser(source).block(())[0])
        self.run = self._block(self.tree, outer=True)

    # Constants are folded: expressions of constants become constants, tests that are known leave one arm, texts join.
    def _fold(self, e: tuple) -> tuple:
        if e[0] in ("const", "name"):
            return e
        if e[0] == "filter":
            if e[1] not in self.filters:
                raise TemplateError(f"filter {e[1]}")
            e = ("filter", e[1], self._fold(e[2]), self._fold(e[3]))
            args = e[2:]
        else:
            e = (e[0], *map(self._fold, e[1:]))
            args = e[1:]
        return ("const", self._value(e)({})) if all(a[0] == "const" for a in args) else e

    def _fold_block(self, nodes: list) -> list:
        out: list = []
        for n in nodes:
            if n[0] == "out":
                e = self._fold(n[1])
                n = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
            elif n[0] == "for":
                n = ("for", n[1], self._fold(n[2]), self._fold_block(n[3]))
            elif n[0] == "generation":
                n = ("generation", self._fold_block(n[1]))
            elif n[0] == "set":
                n = ("set", n[1], self._fold(n[2]))
            elif n[0] == "if":
                arms = [(t, self._fold_block(b)) for t, b in ((self._fold(t), b) for t, b in n[1]) if t[0] != "const" or t[1]]
                k = next((k for k, (t, _) in enumerate(arms) if t[0] == "const"), len(arms))
                arms = arms[: k + 1]
                if not arms or k == 0:
                    for m in arms[0][1] if arms else []:
                        self._push(out, m)
                    continue
                n = ("if", arms)
            self._push(out, n)
        return out

    @staticmethod
    def _push(out: list, n: tuple) -> None:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        elif n != ("text", ""):
            out.append(n)

    def _value(self, e: tuple) -> Callable[[dict], object]:
        if e[0] == "const":
            return lambda env, x=e[1]: x
        if e[0] == "name":
            return lambda env, k=e[1]: env.get(k)
        if e[0] == "filter":
            f, x, arg = self.filters[e[1]], self._value(e[2]), self._value(e[3])
            return lambda env: f(x(env), arg(env))
        args = [self._value(a) for a in e[1:]]
        a, b = args[0], args[-1]
        if e[0] == "get":
            return lambda env: m.get(b(env)) if isinstance(m := a(env), dict) else None
        return {
            "not": lambda env: not a(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env),
            "==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "+": lambda env: _text(a(env)) + _text(b(env)),
        }[e[0]]

    def _block(self, nodes: list, outer: bool = False, gen: bool = False) -> Callable[[dict], Iterator[Piece]]:
        steps = [self._node(n, outer, gen) for n in nodes]

        def run(env: dict) -> Iterator[Piece]:
            for s in steps:
                yield from s(env)

        return run

    def _node(self, n: tuple, outer: bool, gen: bool) -> Callable[[dict], Iterator[Piece]]:
        if n[0] == "text":
            return lambda env, piece=(n[1], gen): iter((piece,))
        if n[0] == "out":
            value = self._value(n[1])
            return lambda env: iter(((_text(value(env)), gen),))
        if n[0] == "generation":
            return self._block(n[1], gen=True)
        if n[0] == "set":
            value = self._value(n[2])
            return lambda env: iter((env.__setitem__(n[1], value(env)) or ("", gen),))
        if n[0] == "if":
            arms = [(self._value(t), self._block(b, gen=gen)) for t, b in n[1]]

            def choose(env: dict) -> Iterator[Piece]:
                return next((b(env) for t, b in arms if t(env)), iter(()))

            return choose
        items, body, name = self._value(n[2]), self._block(n[3], gen=gen), n[1]

        def loop(env: dict) -> Iterator[Piece]:
            it, k, end = iter(items(env) or ()), 0, object()
            item = next(it, end)
            while item is not end:
                after = next(it, end)
                yield from body({**env, name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": after is end}})
                if outer:
                    yield "", None
                item, k = after, k + 1

        return loop

    def stream(self, messages: Iterable[dict], **names) -> Iterator[Piece]:
        """The pieces of the rendered conversation."""
        return self.run({**names, "messages": messages})

    def render(self, messages: Iterable[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """The rendered text and its generated spans."""
        return collect(self.stream(messages, **names))


def collect(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """The joined text of pieces and the spans of neighbouring generated ones; a turn's end also ends a span."""
    texts, spans, n, open_ = [], [], 0, False
    for text, gen in pieces:
        if text and gen:
            if open_ and spans[-1][1] == n:
                spans[-1] = (spans[-1][0], n + len(text))
            else:
                spans.append((n, n + len(text)))
        open_ = bool(gen) or (open_ and gen is not None and not text)
        texts.append(text)
        n += len(text)
    return "".join(texts), spans
