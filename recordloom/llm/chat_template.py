"""A small template language, compiled to Python closures.

    {{ expression }}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% for name in expression %} ... {% endfor %}
    {% generation %} ... {% endgeneration %}

Expressions: names, 'strings', whole numbers, true, false; field access (x.name or x['name']) on dicts; == != < >
<= >=, and, or, not, + on texts or numbers, ~ (joins as text), parentheses and filters (x|name).
Templates are sandboxed: a name only looks up the given values, a field only a key of a dict, and a filter must be in
the table that the compiler is given; no attribute, call or import of Python can be reached, and loops only go over
given lists (null: none). In a loop, ``loop`` has index, index0, first and last. What is constant is computed while
compiling, branches on constants are cut and neighbouring texts are joined. Blocks, brackets and ``not`` nested deeper
than ``DEPTH`` are refused. Values are only looked up and written as text, so cyclic ones do no harm unless written.

A compiled template writes to an ``Output``, which records where the text between generation marks lies.
``compile_stream`` compiles a template that is one loop with what stands before and behind it, to be rendered item by
item without ever holding the list.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|([A-Za-z]\w*)|(==|!=|<=|>=|[<>+~|.()\[\]]))", re.S)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
#: How deep blocks and expressions may be nested.
DEPTH = 50
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'"}


class TemplateError(ValueError):
    """A template that the language does not allow, or a value that it cannot use."""


# --- syntax tree ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: str


@dataclass(frozen=True)
class Apply:
    """A function of evaluated operands: comparison, sum, join, negation or filter."""

    function: Callable
    operands: tuple


@dataclass(frozen=True)
class Choice:
    """``and`` (stop at the first false value) or ``or`` (stop at the first true one)."""

    stop_at: bool
    operands: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Branch:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing --------------------------------------------------------------------------------------


def _add(a, b):
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError(f"cannot add {type(a).__name__} and {type(b).__name__}")
    return a + b


def _text(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


class _Expression:
    """Precedence climbing over the tokens of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]) -> None:
        self.tokens, self.filters, at = [], filters, 0
        source = source.rstrip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = match.lastindex
            self.tokens.append((kind, match[kind]))
            at = match.end()
        self.tokens.append((0, ""))
        self.at = self.depth = 0

    def take(self, *symbols: str) -> str | None:
        kind, value = self.tokens[self.at]
        if value in symbols and kind in (3, 4):
            self.at += 1
            return value
        return None

    def need(self, symbol: str) -> None:
        if not self.take(symbol):
            raise TemplateError(f"expected {symbol!r} before {self.tokens[self.at][1]!r}")

    def whole(self):
        tree = self.either()
        if self.tokens[self.at][0]:
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Choice(True, tuple(parts))

    def both(self):
        parts = [self.negated()]
        while self.take("and"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Choice(False, tuple(parts))

    def negated(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError(f"nested deeper than {DEPTH}")
        tree = Apply(operator.not_, (self.negated(),)) if self.take("not") else self.compared()
        self.depth -= 1
        return tree

    def compared(self):
        left = self.summed()
        if symbol := self.take(*_COMPARE):
            return Apply(_COMPARE[symbol], (left, self.summed()))
        return left

    def summed(self):
        tree = self.filtered()
        while symbol := self.take("+", "~"):
            join = _add if symbol == "+" else lambda a, b: _text(a) + _text(b)
            tree = Apply(join, (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.atom()
        while True:
            if self.take("|"):
                name = self.word()
                if name not in self.filters:
                    raise TemplateError(f"unknown filter {name!r}")
                tree = Apply(self.filters[name], (tree,))
            elif self.take("."):
                tree = Field(tree, self.word())
            elif self.take("["):
                kind, value = self.tokens[self.at]
                if kind != 2:
                    raise TemplateError("a field in brackets must be a string")
                self.at += 1
                self.need("]")
                tree = Field(tree, value)
            else:
                return tree

    def word(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != 3:
            raise TemplateError(f"expected a name before {value!r}")
        self.at += 1
        return value

    def atom(self):
        kind, value = self.tokens[self.at]
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if kind not in (1, 2, 3) or value in ("and", "or"):
            raise TemplateError(f"expected a value before {value!r}")
        self.at += 1
        if kind == 1:
            return Const(int(value))
        if kind == 2:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value, flags=re.S))
        return Const(value == "true") if value in ("true", "false") else Name(value)


def parse(source: str, filters: dict[str, Callable]) -> tuple:
    """The syntax tree of a template: a tuple of Emit, Branch, Loop and Generation nodes."""
    # Each open block: (its kind, the node list now written to, what closing it needs).
    top: list = []
    stack: list[tuple[str, list, list]] = [("template", top, [])]
    at = 0

    def expression(text: str):
        return _Expression(text, filters).whole()

    def close(arms: list) -> None:
        node: tuple = ()
        for test, body in reversed(arms):
            node = tuple(body) if test is None else (Branch(test, tuple(body), node),)
        stack[-1][1].extend(node)

    for match in _TAG.finditer(source):
        if match.start() > at:
            stack[-1][1].append(Emit(Const(source[at : match.start()])))
        at = match.end()
        if match[1] is not None:
            stack[-1][1].append(Emit(expression(match[1])))
            continue
        word, _, rest = match[2].strip().partition(" ")
        kind, _, arms = stack[-1]
        if len(stack) > DEPTH and not word.startswith(("end", "el")):
            raise TemplateError(f"nested deeper than {DEPTH}")
        if word == "if":
            body: list = []
            stack.append(("if", body, [(expression(rest), body)]))
        elif word in ("elif", "else") and kind == "if" and arms[-1][0] is not None:
            body = []
            arms.append((expression(rest) if word == "elif" else None, body))
            stack[-1] = ("if", body, arms)
        elif word == "endif" and kind == "if":
            stack.pop()
            close(arms)
        elif word == "for":
            name, _, over = rest.strip().partition(" in ")
            if not re.fullmatch(r"[A-Za-z]\w*", name) or name == "loop":
                raise TemplateError(f"cannot loop with {name!r}")
            stack.append(("for", [], [(name, expression(over))]))
        elif word == "endfor" and kind == "for":
            body = stack.pop()[1]
            stack[-1][1].append(Loop(*arms[0], tuple(body)))
        elif word == "generation" and all(k != "generation" for k, _, _ in stack):
            stack.append(("generation", [], []))
        elif word == "endgeneration" and kind == "generation":
            body = stack.pop()[1]
            stack[-1][1].append(Generation(tuple(body)))
        else:
            raise TemplateError(f"unexpected tag {match[2].strip()!r}")
    if at < len(source):
        stack[-1][1].append(Emit(Const(source[at:])))
    if len(stack) > 1:
        raise TemplateError(f"unclosed {stack[-1][0]}")
    return tuple(top)


# --- folding --------------------------------------------------------------------------------------


def fold_expression(tree):
    """The same expression with everything constant computed."""
    if isinstance(tree, Apply):
        operands = tuple(map(fold_expression, tree.operands))
        if all(isinstance(x, Const) for x in operands):
            return Const(tree.function(*(x.value for x in operands)))
        return Apply(tree.function, operands)
    if isinstance(tree, Choice):
        left: list = []
        for x in map(fold_expression, tree.operands):
            if isinstance(x, Const) and bool(x.value) == tree.stop_at:
                return x if not left else Choice(tree.stop_at, (*left, x))
            left.append(x)
        # A constant that does not decide may go, unless it is the value of the whole.
        left = [x for x in left[:-1] if not isinstance(x, Const)] + left[-1:]
        return left[0] if len(left) == 1 else Choice(tree.stop_at, tuple(left))
    if isinstance(tree, Field):
        return Field(fold_expression(tree.of), tree.key)
    return tree


def fold(nodes: tuple) -> tuple:
    """The same template with constants computed, decided branches cut and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Branch):
            test = fold_expression(node.test)
            if isinstance(test, Const):
                new = list(fold(node.then if test.value else node.other))
            else:
                new = [Branch(test, fold(node.then), fold(node.other))]
        elif isinstance(node, Loop):
            new = [Loop(node.name, fold_expression(node.over), fold(node.body))]
        elif isinstance(node, Generation):
            new = [Generation(fold(node.body))]
        else:
            value = fold_expression(node.value)
            new = [Emit(Const(_text(value.value)) if isinstance(value, Const) else value)]
        for x in new:
            both = isinstance(x, Emit) and isinstance(x.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const)
            if both:
                out[-1] = Emit(Const(out[-1].value.value + x.value.value))
            else:
                out.append(x)
    return tuple(out)


# --- code generation ------------------------------------------------------------------------------


@dataclass
class Output:
    """Rendered text, and the (start, end) spans of code points between generation marks."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def _value(tree) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        constant = tree.value
        return lambda values: constant
    if isinstance(tree, Name):
        name = tree.name
        return lambda values: values.get(name)
    if isinstance(tree, Field):
        of, key = _value(tree.of), tree.key

        def field_of(values):
            found = of(values)
            return found.get(key) if isinstance(found, dict) else None

        return field_of
    if isinstance(tree, Choice):
        operands, stop_at = [_value(x) for x in tree.operands], tree.stop_at

        def choose(values):
            found = None
            for operand in operands:
                found = operand(values)
                if bool(found) == stop_at:
                    break
            return found

        return choose
    function, operands = tree.function, [_value(x) for x in tree.operands]
    if len(operands) == 1:
        only = operands[0]
        return lambda values: function(only(values))
    left, right = operands
    return lambda values: function(left(values), right(values))


def _writer(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda values, out: out.write(text)
        value = _value(node.value)
        return lambda values, out: out.write(_text(value(values)))
    if isinstance(node, Branch):
        test, then, other = _value(node.test), _writers(node.then), _writers(node.other)
        return lambda values, out: (then if test(values) else other)(values, out)
    if isinstance(node, Loop):
        over, step = _value(node.over), _step(node)

        def loop(values, out):
            items = over(values)
            if items is not None and not isinstance(items, list):
                raise TemplateError(f"cannot loop over {type(items).__name__}")
            for index, item in enumerate(items or ()):
                step(values, out, item, index, index + 1 == len(items))

        return loop
    body = _writers(node.body)

    def generation(values, out):
        start = out.size
        body(values, out)
        out.spans.append((start, out.size))

    return generation


def _step(node: Loop) -> Callable:
    """One turn of a loop: what the body writes for an item, given its place and whether it is the last."""
    name, body = node.name, _writers(node.body)

    def step(values, out, item, index, last):
        body({**values, name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": last}}, out)

    return step


def _writers(nodes: tuple) -> Callable[[dict, Output], None]:
    steps = [_writer(node) for node in nodes]

    def run(values, out):
        for step in steps:
            step(values, out)

    return run


def compile_template(source: str, filters: dict[str, Callable]) -> Callable[[dict], Output]:
    """A function from values (a dict) to the rendered Output."""
    run = _writers(fold(parse(source, filters)))

    def render(values: dict) -> Output:
        out = Output()
        run(values, out)
        return out

    return render


def compile_stream(source: str, filters: dict[str, Callable], over: str) -> Callable[[dict, object, int, bool], Output]:
    """A function from (values, item, index, last) to one item's part of a template that loops over the list ``over``.

    The loop must be the only one at the top of the template. What stands before it is written with the first item, what
    stands behind it with the last one; neither may use the list. The parts in order are what ``compile_template`` writes
    for a list of at least one item.
    """
    nodes = fold(parse(source, filters))
    at = [i for i, node in enumerate(nodes) if isinstance(node, Loop)]
    if len(at) != 1 or nodes[at[0]].over != Name(over):
        raise TemplateError(f"expected one loop over {over!r} at the top")
    before, step, behind = _writers(nodes[: at[0]]), _step(nodes[at[0]]), _writers(nodes[at[0] + 1 :])

    def render(values: dict, item: object, index: int, last: bool) -> Output:
        out = Output()
        if index == 0:
            before(values, out)
        step(values, out, item, index, last)
        if last:
            behind(values, out)
        return out

    return render
