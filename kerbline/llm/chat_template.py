"""Operator 12: chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded (literals, branches whose test is known, neighbouring
text), and the tree becomes Python closures that yield the formatted conversation piece by piece.  The language is
a sandbox: expressions see the fields of the current message, `loop` and variables set in the template; there are no
calls, no attributes of Python objects and no way to import, write or loop over anything but `messages`.

    {{ expr }}   {% set x = expr %}   {# comment #}   - beside a delimiter strips white space on that side
    {% for m in messages %} .. {% endfor %}
    {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}      what is inside counts in the loss
    expr: 'text' 12 true false none name m.field m['field'] loop.first loop.last loop.index loop.index0
          not and or == != < <= > >= in ~ + - * % ( ) expr if expr else expr
          expr | lower upper trim length string escape default(expr)

The filter `escape` breaks every control string in a text by a backslash after its first character and doubles
backslashes, so no text can end a turn or begin one; `unescape` gives the text back, whatever it holds.

Conversations are sorted within partitions and streamed: a conversation of any length goes through its task turn by
turn, and is handed on in parts of about PART_CHARS.  A conversation's parts are made in order by one task, as their
digest has to be; memory does not grow with its length.

Edge cases: a null text is empty, a null role likewise; null conversation ids are one conversation; turns that share a
number go by role and text, a null number comes first; repeated rows are turns of their own; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, claim, small_batches

#: Characters of a formatted part, about.
PART_CHARS = 1_000_000
ESCAPE = "\\"

#: Control strings of public chat formats, fixed values.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Turns as head, role, separator, text, end; assistant texts are what a model learns to write.
TURNS = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>{% if not loop.last %}{{ '\\n' }}{% endif %}{% endfor %}"
)


class TemplateError(ValueError):
    """A template that is not in the language, or a value that an expression cannot take."""


# --------------------------------------------------------------------- escaping
class Escaper:
    """Reversible: no control string is left in an escaped text."""

    def __init__(self, controls: Iterable[str]):
        controls = sorted(set(controls), key=len, reverse=True)
        if any(len(c) < 2 or ESCAPE in c for c in controls):
            raise TemplateError("control strings have two characters or more and no backslash")
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)
        self._risky = re.compile(re.escape(ESCAPE) + (f"|{heads}" if heads else ""))
        self._marked = re.compile(r"\\(\\?)")

    def escape(self, text: str) -> str:
        return self._risky.sub(lambda m: m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return self._marked.sub(r"\1", text)


# --------------------------------------------------------------------- syntax tree
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """A pure operation on the values of its parts."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    then: object
    other: object


@dataclass(frozen=True)
class Either:
    """`or` (stop is true) and `and` (false): the first value that settles it."""

    left: object
    right: object
    stop: bool


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Let:
    name: str
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generated:
    body: tuple


_BINARY = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "-": operator.sub, "%": operator.mod}


def _show(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _number(value: object) -> int | float:
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise TemplateError(f"{value!r} is not a number")
    return value


def _operation(op: str, escaper: Escaper) -> Callable:
    if op == "+":
        return lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b)
    if op == "*":
        # numbers only: a text times a number would be a bomb
        return lambda a, b: _number(a) * _number(b)
    if op in ("-", "%"):
        return lambda a, b, f=_BINARY[op]: f(_number(a), _number(b))
    return {
        "~": lambda a, b: _show(a) + _show(b),
        "in": lambda a, b: _show(a) in _show(b),
        "not in": lambda a, b: _show(a) not in _show(b),
        "not": operator.not_,
        "negative": lambda a: -_number(a),
        "lower": lambda a: _show(a).lower(),
        "upper": lambda a: _show(a).upper(),
        "trim": lambda a: _show(a).strip(),
        "length": lambda a: len(_show(a)),
        "string": _show,
        "escape": lambda a: escaper.escape(_show(a)),
        "default": lambda a, b: b if a is None else a,
    }.get(op) or _BINARY[op]


_FILTERS = {"lower": 1, "upper": 1, "trim": 1, "length": 1, "string": 1, "escape": 1, "default": 2}
_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*%~|().\[\]<>=,]))""")
_LETTERS = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}
_DEEPEST = 50


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(kind, content): text, output, tag; comments are gone and white space is stripped where a hyphen says so."""
    at, strip = 0, False
    while at <= len(source):
        found = _TAG.search(source, at)
        text = source[at : found.start() if found else len(source)]
        text = text.lstrip() if strip else text
        if found and found[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not found:
            return
        kind = {"{": "output", "%": "tag", "#": "comment"}[found[0][1]]
        close = {"output": "}}", "tag": "%}", "comment": "#}"}[kind]
        end = _closing(source, found.end(), close) if kind != "comment" else source.find(close, found.end())
        if end < 0:
            raise TemplateError(f"{found[0]} is not closed")
        content = source[found.end() : end]
        strip = kind != "comment" and content.endswith("-")
        if kind != "comment":
            yield kind, (content[:-1] if strip else content).strip()
        at = end + 2


def _closing(source: str, at: int, close: str) -> int:
    """Where a delimiter outside quotes stands."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif source.startswith(close, at):
            return at
        at += 1
    return -1


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = [], 0, 0
        at, source = 0, source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()

    def whole(self):
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")
        return node

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def choice(self):
        self.depth += 1
        if self.depth > _DEEPEST:
            raise TemplateError("nested too deeply")
        node = self.either()
        if self.take("if"):
            test = self.either()
            node = Choice(test, node, self.choice() if self.take("else") else Const(None))
        self.depth -= 1
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Either(node, self.both(), True)
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Either(node, self.negated(), False)
        return node

    def negated(self):
        turns = 0
        while self.take("not"):
            turns += 1
        node = self.compared()
        for _ in range(min(turns, 2 + turns % 2)):
            node = Apply("not", (node,))
        return node

    def compared(self):
        node = self.summed()
        while True:
            op = self.take("==", "!=", "<", "<=", ">", ">=", "in")
            if op is None and self.at + 1 < len(self.tokens) and [t[1] for t in self.tokens[self.at : self.at + 2]] == ["not", "in"]:
                self.at, op = self.at + 2, "not in"
            if op is None:
                return node
            node = Apply(op, (node, self.summed()))

    def summed(self):
        node = self.product()
        while op := self.take("+", "-", "~"):
            node = Apply(op, (node, self.product()))
        return node

    def product(self):
        node = self.filtered()
        while op := self.take("*", "%"):
            node = Apply(op, (node, self.filtered()))
        return node

    def filtered(self):
        negative = self.take("-")
        node = self.value()
        while True:
            if self.take("."):
                node = Field(node, Const(self.name()))
            elif self.take("["):
                node = Field(node, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in _FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                parts = [node]
                if self.take("("):
                    parts.append(self.choice())
                    self.need(")")
                if len(parts) != _FILTERS[name]:
                    raise TemplateError(f"filter {name!r} takes {_FILTERS[name] - 1} values")
                node = Apply(name, tuple(parts))
            else:
                return Apply("negative", (node,)) if negative else node

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self):
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at == len(self.tokens):
            raise TemplateError("a value is missing")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Const(int(word))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _LETTERS.get(m[1], m[1]), word[1:-1], flags=re.S))
        if word.lower() in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[word.lower()])
        if kind != "name" or word in _WORDS:
            raise TemplateError(f"{word!r} is no value")
        return Name(word)


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    pieces = list(_pieces(source))
    at = 0

    def block(ends: tuple[str, ...], scope: frozenset, depth: int) -> tuple[tuple, str]:
        nonlocal at
        if depth > _DEEPEST:
            raise TemplateError("nested too deeply")
        out, names = [], set(scope)

        def expression(text: str):
            node = _Expression(text).whole()
            _known(node, names)
            return node

        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            word, _, rest = content.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "text":
                out.append(Text(content))
            elif kind == "output":
                out.append(Output(expression(content)))
            elif word in ends:
                return tuple(out), content
            elif word == "set":
                name, sign, value = rest.partition("=")
                if not sign or not name.strip().isidentifier() or name.strip() in _WORDS | {"messages", "loop"}:
                    raise TemplateError(f"cannot set {rest!r}")
                out.append(Let(name.strip(), expression(value)))
                names.add(name.strip())
            elif word == "for":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not found or "loop" in names or found[1] in _WORDS | {"messages", "loop"}:
                    raise TemplateError(f"cannot loop {rest!r}")
                body, _ = block(("endfor",), frozenset(names | {found[1], "loop"}), depth + 1)
                out.append(Loop(found[1], body))
            elif word == "generation":
                body, _ = block(("endgeneration",), frozenset(names), depth + 1)
                if any(isinstance(n, Generated) for n in walk(body)):
                    raise TemplateError("generation inside generation")
                out.append(Generated(body))
            elif word == "if":
                tests, content = [], content
                while True:
                    word, _, rest = content.partition(" ")
                    if word in ("if", "elif"):
                        test = expression(rest)
                        body, content = block(("elif", "else", "endif"), frozenset(names), depth + 1)
                        tests.append((test, body))
                    elif word == "else":
                        last, content = block(("endif",), frozenset(names), depth + 1)
                        break
                    else:
                        last = ()
                        break
                for test, body in reversed(tests):
                    last = (Branch(test, body, last),)
                out.extend(last)
            else:
                raise TemplateError(f"no tag {content!r} here")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), ""

    tree, _ = block((), frozenset(), 0)
    if sum(isinstance(n, Loop) for n in walk(tree)) > 1:
        raise TemplateError("messages are streamed: one loop over them")
    return tree


def walk(node) -> Iterator:
    """All nodes below."""
    for child in node if isinstance(node, tuple) else [getattr(node, f) for f in node.__dataclass_fields__]:
        if isinstance(child, tuple) or hasattr(child, "__dataclass_fields__"):
            if not isinstance(child, tuple):
                yield child
            yield from walk(child)


def _known(node, names: set) -> None:
    for n in (node, *walk(node)):
        if isinstance(n, Name) and n.name not in names:
            raise TemplateError(f"{n.name!r} is not known here")


# --------------------------------------------------------------------- folding
def fold(node, escaper: Escaper):
    """The same template with constant parts worked out."""
    if isinstance(node, tuple):
        out: list = []
        for part in (fold(n, escaper) for n in node):
            for n in part if isinstance(part, tuple) else (part,):
                if isinstance(n, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + n.text)
                elif n != Text(""):
                    out.append(n)
        return tuple(out)
    if isinstance(node, Apply):
        parts = tuple(fold(p, escaper) for p in node.parts)
        if all(isinstance(p, Const) for p in parts):
            return Const(_safely(_operation(node.op, escaper), [p.value for p in parts]))
        return Apply(node.op, parts)
    if isinstance(node, Choice):
        test = fold(node.test, escaper)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, escaper)
        return Choice(test, fold(node.then, escaper), fold(node.other, escaper))
    if isinstance(node, Either):
        left, right = fold(node.left, escaper), fold(node.right, escaper)
        if isinstance(left, Const):
            return left if bool(left.value) == node.stop else right
        return Either(left, right, node.stop)
    if isinstance(node, Field):
        return Field(fold(node.of, escaper), fold(node.key, escaper))
    if isinstance(node, Output):
        value = fold(node.value, escaper)
        return Text(_show(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, Let):
        return Let(node.name, fold(node.value, escaper))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.body, escaper))
    if isinstance(node, Generated):
        return Generated(fold(node.body, escaper))
    if isinstance(node, Branch):
        test = fold(node.test, escaper)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, escaper)
        return Branch(test, fold(node.then, escaper), fold(node.other, escaper))
    return node


def _safely(f: Callable, values: list):
    try:
        return f(*values)
    except (TypeError, ZeroDivisionError) as e:
        raise TemplateError(str(e)) from e


# --------------------------------------------------------------------- closures
def _value(node, escaper: Escaper) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        return lambda scope: scope.get(node.name)
    if isinstance(node, Field):
        of, key = _value(node.of, escaper), _value(node.key, escaper)

        def field(scope: dict):
            holder = of(scope)
            return holder.get(key(scope)) if isinstance(holder, dict) else None

        return field
    if isinstance(node, Choice):
        test, then, other = (_value(n, escaper) for n in (node.test, node.then, node.other))
        return lambda scope: then(scope) if test(scope) else other(scope)
    if isinstance(node, Either):
        left, right = _value(node.left, escaper), _value(node.right, escaper)

        def either(scope: dict):
            value = left(scope)
            return value if bool(value) == node.stop else right(scope)

        return either
    f, parts = _operation(node.op, escaper), [_value(p, escaper) for p in node.parts]
    return lambda scope: _safely(f, [p(scope) for p in parts])


def _body(nodes: tuple, escaper: Escaper) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    steps = [_step(n, escaper) for n in nodes]

    def run(scope: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope)

    return run


def _step(node, escaper: Escaper) -> Callable[[dict], Iterable[tuple[str, bool]]]:
    if isinstance(node, Text):
        said = ((node.text, False),)
        return lambda scope: said
    if isinstance(node, Output):
        value = _value(node.value, escaper)
        return lambda scope: ((_show(value(scope)), False),)
    if isinstance(node, Let):
        value = _value(node.value, escaper)

        def put(scope: dict):
            scope[node.name] = value(scope)
            return ()

        return put
    if isinstance(node, Branch):
        test, then, other = _value(node.test, escaper), _body(node.then, escaper), _body(node.other, escaper)
        return lambda scope: then(scope) if test(scope) else other(scope)
    body = _body(node.body, escaper)
    if isinstance(node, Generated):
        return lambda scope: (("".join(text for text, _ in body(scope)), True),)

    def loop(scope: dict) -> Iterator[tuple[str, bool]]:
        messages = iter(scope["messages"])
        now, index = next(messages, None), 0
        while now is not None:
            after = next(messages, None)
            index += 1
            yield from body(scope | {node.name: now, "loop": {"index": index, "index0": index - 1, "first": index == 1, "last": after is None}})
            now = after

    return loop


def compile_template(source: str, controls: Iterable[str] = CONTROLS) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (dicts, taken one by one) to pieces of text, each with whether it is generated."""
    escaper = Escaper(controls)
    run = _body(fold(parse(source), escaper), escaper)
    return lambda messages: run({"messages": messages})


# --------------------------------------------------------------------- over tables
def format_conversations(
    rows: DataFrame,
    template: str = TURNS,
    controls: Iterable[str] = CONTROLS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, part (from 0), last (whether it is the conversation's last part), formatted, loss (spans start, end in code points of the part).

    The template sees role, text and turn of each message.  Parts follow one another in the rows of a task; a
    conversation of up to PART_CHARS is one part.
    """
    small_batches(rows.sparkSession)
    controls = tuple(controls)
    compile_template(template, controls)  # errors show here
    own = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def work(stream):
        claim("chat_template")
        render = compile_template(template, controls)
        turns = (
            message
            for piece in batches(stream, "text")
            for message in zip(*[piece[c].to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True)
        )
        out: list[tuple] = []
        held = 0
        for conv, messages in _by_conversation(turns):
            part, chars, texts, spans = 0, 0, [], []
            for text, generated in render(messages):
                if chars and chars + len(text) > PART_CHARS:
                    out.append((conv, part, False, "".join(texts), spans))
                    held += chars
                    part, chars, texts, spans = part + 1, 0, [], []
                if generated:
                    spans.append({"start": chars, "end": chars + len(text)})
                texts.append(text)
                chars += len(text)
                if held > PART_CHARS:
                    yield _parts(out)
                    out, held = [], 0
            out.append((conv, part, True, "".join(texts), spans))
            held += chars
        if out:
            yield _parts(out)

    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(work, "conv_id long, part long, last boolean, formatted string, loss array<struct<start: long, end: long>>")


_PARTS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)


def _by_conversation(turns: Iterator[tuple]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its messages), each taken from the stream when it is asked for."""
    now = next(turns, None)
    while now is not None:
        conv = now[0]

        def messages():
            nonlocal now
            while now is not None and now[0] == conv:
                message = {"turn": now[1], "role": now[2], "text": now[3]}
                now = next(turns, None)
                yield message

        yield conv, messages()
        while now is not None and now[0] == conv:
            now = next(turns, None)


class _Reader:
    """What the parts of one conversation say, read as they come."""

    def __init__(self, escaper: Escaper, head: str, separator: str, end: str):
        self.escaper, self.head, self.separator, self.end = escaper, head, separator, end
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, text: str, spans: list[dict], last: bool) -> None:
        self.chars += len(text)
        for span in spans:
            own = self.escaper.unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        self.rest += text
        # a control string is only complete with the part that ends it
        turns = self.rest.split(self.end)
        self.rest = turns.pop()
        for turn in turns:
            _, found, body = turn.partition(self.head)
            role, split, body = body.partition(self.separator)
            if not found or not split:
                raise ValueError("a turn without its marks")
            self.turns += 1
            self.said.update(f"{self.escaper.unescape(role)}\n{self.escaper.unescape(body)}\n".encode())
        if last and self.head in self.rest:
            raise ValueError("a turn that does not end")


def read_back(formatted: DataFrame, controls: Iterable[str] = CONTROLS, head: str = "<|im_start|>", separator: str = "<|im_sep|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read from its formatted parts alone.

    formatted: the result of format_conversations, whose tasks have a conversation's parts in order.
    """
    controls = tuple(controls)

    def work(stream):
        escaper, reader, out = Escaper(controls), None, []
        for batch in stream:
            for conv, _, last, text, spans in zip(*[batch[c.name].to_pylist() for c in _PARTS], strict=True):
                reader = reader or _Reader(escaper, head, separator, end)
                reader.take(text, spans, last)
                if last:
                    out.append((conv, reader.turns, reader.said.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
                    reader = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _READ, strict=True)], names=_READ_NAMES)
                out = []

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
_READ_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
