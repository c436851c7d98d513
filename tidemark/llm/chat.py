"""Chat formatting: a sandboxed template language, compiled to Python closures.

A template is parsed into a syntax tree, constants are folded, and each node becomes a
closure that yields pieces of output with a flag: whether a model generates them.
Templates see the given messages and their own loop variables only: names are looked
up, keys and indexes are taken from mappings and lists, a fixed set of filters may be
called; there are no attributes, imports or other calls, and no loop but over given rows.

    {{ m.text | escape }}   {% for m in messages %} {% endfor %}   {% if %} {% elif %}
    {% else %} {% endif %}  {% set x = 1 %}  {% generation %} {% endgeneration %}  {# #}

``-`` inside a mark strips white space beside it. Operators: ``or and not in == != < <=
> >= + - * % ~ | [] .``, ``a if b else c``, ``is [not] defined``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import batches, lean


class TemplateError(ValueError):
    """A template that can't be parsed, or that does what it may not."""


def escape(text) -> str:
    """text without bare control characters of the turn marks; unescape() reverts it."""
    return str("" if text is None else text).replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


TURNS = (
    "{% for m in messages %}<turn {{ m.role | escape }}>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
_TURN = re.compile(r"<turn ([^\\>]*+(?:\\.[^\\>]*+)*+)>\n([^\\<]*+(?:\\.[^\\<]*+)*+)</turn>\n", re.S)
#: Characters of output after which a piece of it is handed on.
CHUNK = 1 << 16

_UNDEFINED = object()


def _text(x) -> str:
    return "" if x is None or x is _UNDEFINED else str(x)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
    "string": _text,
    "default": lambda x, y="": y if x is _UNDEFINED or x is None else x,
    "replace": lambda x, a, b: _text(x).replace(a, b),
}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b), "%": lambda a, b: _rest(a, b), "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}


def _times(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("* takes whole numbers")
    return a * b


def _rest(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("% takes whole numbers")
    return a % b


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (test, body) each; the last may have the test Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


_MARKS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-<>+*%~|().,\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _marks(source: str) -> Iterator[tuple[str, str]]:
    """(kind, content): text, out and do pieces of a template."""
    at, strip = 0, False
    for m in _MARKS.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] or m[4] or m[7] else text
        if text:
            yield "text", text
        if m[2] is not None:
            yield "out", m[2]
        elif m[5] is not None:
            yield "do", m[5].strip()
        strip = bool(m[3] or m[6] or m[8])
        at = m.end()
    text = source[at:].lstrip() if strip else source[at:]
    if "{{" in text or "{%" in text:
        raise TemplateError("a mark isn't closed")
    if text:
        yield "text", text


class _Expression:
    """A parser of one expression, by precedence."""

    LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("+", "-", "~"), ("*", "%"))

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unknown sign in {source!r}")
            kind = next(k for k in range(1, 5) if m[k] is not None)
            self.tokens.append((("int", "name", "str", "sign")[kind - 1], m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str | None:
        at = self.at + k
        return self.tokens[at][1] if at < len(self.tokens) and self.tokens[at][0] in ("name", "sign") else None

    def take(self, *signs: str) -> str | None:
        if self.peek() in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self):
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]} isn't expected")
        return found

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("if", (test, value, self.choice()))
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negation()
        while self.take("and"):
            left = Op("and", (left, self.negation()))
        return left

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            if level == 0 and self.take("is"):
                negative = self.take("not")
                if self.name() != "defined":
                    raise TemplateError("is takes defined only")
                left = Op("defined", (left,))
                left = Op("not", (left,)) if negative else left
            elif level == 0 and self.peek() == "not" and self.peek(1) == "in":
                self.at += 2
                left = Op("not in", (left, self.binary(level + 1)))
            elif sign := self.take(*self.LEVELS[level]):
                left = Op(sign, (left, self.binary(level + 1)))
            else:
                return left

    def unary(self):
        if self.take("-"):
            return Op("-", (Const(0), self.unary()))
        found = self.primary()
        while True:
            if self.take("."):
                found = Item(found, Const(self.name()))
            elif self.take("["):
                found = Item(found, self.choice())
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), [found]
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.choice())
                        if self.peek() != ")":
                            self.need(",")
                found = Filter(name, tuple(args))
            else:
                return found

    def primary(self):
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(int(token))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            return Const(known[token.lower()]) if token.lower() in known else Name(token)
        raise TemplateError(f"{token} isn't expected")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    marks = list(_marks(source))
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        body: list = []
        while at < len(marks):
            kind, content = marks[at]
            at += 1
            if kind == "text":
                body.append(Out(Const(content)))
                continue
            if kind == "out":
                body.append(Out(_Expression(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(body), word, rest
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                if not m:
                    raise TemplateError("for takes: name in expression")
                body.append(For(m[1], _Expression(m[2]).whole(), block("endfor")[0]))
            elif word == "if":
                arms, test, end = [], _Expression(rest).whole(), ""
                while end != "endif":
                    inner, end, more = block("elif", "else", "endif")
                    arms.append((test, inner))
                    test = _Expression(more).whole() if end == "elif" else Const(True)
                    if end == "else":
                        inner, end, _ = block("endif")
                        arms.append((test, inner))
                body.append(If(tuple(arms)))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError("set takes: name = expression")
                body.append(Set(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"{word} isn't expected")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), "", ""

    return block()[0]


def fold(node):
    """The tree with what is constant computed, neighbouring texts joined and dead arms gone."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            if isinstance(x, tuple):
                out.extend(x)
            else:
                out.append(x)
        joined: list = []
        for x in out:
            if isinstance(x, Out) and isinstance(x.value, Const) and joined and isinstance(joined[-1], Out) and isinstance(joined[-1].value, Const):
                joined[-1] = Out(Const(_text(joined[-1].value.value) + _text(x.value.value)))
            else:
                joined.append(x)
        return tuple(joined)
    if isinstance(node, Op | Filter):
        node = type(node)(node.op if isinstance(node, Op) else node.name, tuple(map(fold, node.args)))
        if all(isinstance(x, Const) for x in node.args):
            try:
                return Const(_value(node)({}))
            except Exception:  # fails when rendered, if it gets there
                return node
        return node
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        body = fold(node.body)
        return Generation(body) if body else ()
    if isinstance(node, If):
        arms = []
        for test, body in node.arms:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            arms.append((test, fold(body)))
            if isinstance(test, Const):
                break
        if not arms or isinstance(arms[0][0], Const):
            return arms[0][1] if arms else ()
        return If(tuple(arms))
    return node


def _value(node) -> Callable[[dict], object]:
    """A closure that gives an expression's value."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n, _UNDEFINED)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(env):
            x, k = of(env), key(env)
            if isinstance(x, dict):
                return x.get(k, _UNDEFINED)
            if isinstance(x, list) and isinstance(k, int):
                return x[k] if -len(x) <= k < len(x) else _UNDEFINED
            return _UNDEFINED

        return item
    args = [_value(x) for x in node.args]
    if isinstance(node, Filter):
        f = FILTERS[node.name]
        return lambda env: f(*[x(env) for x in args])
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.op == "not":
        return lambda env: not args[0](env)
    if node.op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.op == "defined":
        return lambda env: args[0](env) is not _UNDEFINED
    f = _BINARY[node.op]
    return lambda env: f(args[0](env), args[1](env))


def _statements(body: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    """A closure that yields the pieces of a body."""
    steps = [_statement(x) for x in body]

    def run(env: dict, generated: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, generated)

    return run


def _statement(node):
    if isinstance(node, Out):
        value = _value(node.value)

        def out(env, generated):
            text = _text(value(env))
            if text:
                yield text, generated

        return out
    if isinstance(node, Set):
        value = _value(node.value)

        def put(env, generated):
            env[node.name] = value(env)
            return iter(())

        return put
    if isinstance(node, Generation):
        body = _statements(node.body)
        return lambda env, generated: body(env, True)
    if isinstance(node, If):
        arms = [(_value(t), _statements(b)) for t, b in node.arms]

        def choose(env, generated):
            for test, body in arms:
                x = test(env)
                if x and x is not _UNDEFINED:
                    yield from body(env, generated)
                    return

        return choose
    over, body = _value(node.over), _statements(node.body)

    def loop(env, generated):
        rows = over(env)
        if rows is _UNDEFINED or rows is None:
            return
        if isinstance(rows, str | int | dict):
            raise TemplateError("for takes rows")
        rows = iter(rows)
        row = next(rows, _UNDEFINED)
        i = 0
        inner = dict(env)
        while row is not _UNDEFINED:  # one row ahead, for loop.last
            after = next(rows, _UNDEFINED)
            inner[node.name] = row
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": after is _UNDEFINED}
            yield from body(inner, generated)
            row, i = after, i + 1

    return loop


def _uses(node, name: str) -> int:
    """How often a name is read, outside the head of a for loop over it: twice counts as many."""
    if isinstance(node, Name):
        return 2 * (node.name == name)
    if isinstance(node, For):
        head = 1 if node.over == Name(name) else _uses(node.over, name)
        return head + 2 * _uses(node.body, name)
    if isinstance(node, tuple):
        return sum(_uses(x, name) for x in node)
    return sum(_uses(getattr(node, k), name) for k in getattr(node, "__dataclass_fields__", ()))


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (dicts) to pieces of output, each with whether it is generated.

    If the template's only use of messages is one loop over them, they are taken one by
    one as the output is, and never held together.
    """
    tree = fold(parse(source))
    run = _statements(tree)
    streams = _uses(tree, "messages") <= 1
    return lambda messages: run({"messages": messages if streams else list(messages)}, False)


def formatted(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """conv_id, chunk, text, loss: the output of each conversation in chunks of about CHUNK characters.

    Rows of a conversation are its messages (role, text), by turn, role and text; a null
    role or text is empty. loss: spans (start, end) of generated characters of the chunk.
    A chunk never ends inside an inserted value. Rows with null conv_id are one
    conversation. Conversations stream through a task, however long.
    """
    compile_template(template)  # fails here, not in tasks
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        messages = (row for batch in it for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))

        def chunks() -> Iterator[tuple]:
            for conv, own in itertools.groupby(messages, key=lambda r: r[0]):
                k, size, parts, loss = 0, 0, [], []
                for piece, generated in render({"role": r[1], "text": r[2]} for r in own):
                    if generated:
                        if loss and loss[-1]["end"] == size:
                            loss[-1]["end"] += len(piece)
                        else:
                            loss.append({"start": size, "end": size + len(piece)})
                    parts.append(piece)
                    size += len(piece)
                    if size >= CHUNK:
                        yield conv, k, "".join(parts), loss
                        k, size, parts, loss = k + 1, 0, [], []
                if parts or not k:
                    yield conv, k, "".join(parts), loss

        kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        for some in itertools.batched(chunks(), 100):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=["conv_id", "chunk", "text", "loss"])

    return batches(rows, run, "conv_id long, chunk int, text string, loss array<struct<start:int,end:int>>")


def read_turns(chunks: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in the output of TURNS."""
    rest = ""
    for text in chunks:
        rest += text
        at = 0
        while m := _TURN.match(rest, at):
            yield unescape(m[1]), unescape(m[2])
            at = m.end()
        rest = rest[at:]
    if rest:
        raise ValueError("the output ends inside a turn")


def digests(chunks: DataFrame) -> DataFrame:
    """What is read back from formatted(): digests and lengths of each conversation's turns and loss."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in it for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))

        def read() -> Iterator[tuple]:
            for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
                loss, n_loss, n_chars = hashlib.sha256(), 0, 0

                def texts(own=own, loss=loss) -> Iterator[str]:
                    nonlocal n_loss, n_chars
                    for _, _, text, spans in own:
                        n_chars += len(text)
                        for x in spans:
                            part = unescape(text[x["start"] : x["end"]])
                            n_loss += len(part)
                            loss.update(part.encode())
                        yield text

                turns, n = hashlib.sha256(), 0
                for role, text in read_turns(texts()):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                yield conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for some in itertools.batched(read(), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chunks.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
