"""Chat formatting: templates compiled to closures, generation markers, and reading back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import boxed, field, number_id, shuffle_partitions

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}"
    "[OUT] {% generation %}{{ m.text | escape }}{% endgeneration %} [/OUT]</s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE][TEXT] {{ m.text | escape }} [/TEXT]{% endif %}"
    "{% endfor %}"
)

# Control strings begin with one of two brackets. Inside a text a backslash is put behind the
# bracket, and one more where there are backslashes already, so it can be taken out again.
_CONTROL = r"/?(?:s>|(?:INST|OUT|ROLE|TEXT)\])"
_TO_ESCAPE = re.compile(r"([<\[])(\\*)(?=%s)" % _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=%s)" % _CONTROL)
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|\[OUT\] (?P<assistant>.*?) \[/OUT\]</s>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\]\[TEXT\] (?P<text>.*?) \[/TEXT\]", re.DOTALL)

PIECE_CHARS = 1 << 16

Scope = dict[str, Any]
Renderer = Callable[[Scope], Iterator[tuple[str, bool]]]


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class TemplateError(ValueError):
    """The template is not in the language."""


# ---------------------------------------------------------------- expressions

_LEXEMES = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[+~|.()]))")
_WORDS = {"and", "or", "not", "in", "is"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)), "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "length": len,
}


def _text(value: Any) -> str:
    return "" if value is None else str(value)


class _Expression:
    """Recursive descent over one expression; nodes are ('const', v) or ('code', closure).

    The language is a sandbox: names of the scope, fields of mappings, literals, comparison,
    joining and the listed filters. There are no calls, and no Python attributes.
    """

    def __init__(self, source: str):
        self.lexemes: list[tuple[str, str]] = []
        at = 0
        while at < len(source.rstrip()):
            m = _LEXEMES.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            kind = m.lastgroup or ""
            self.lexemes.append(("sign" if m[kind] in _WORDS else kind, m[kind]))
            at = m.end()
        self.at = 0

    def parse(self) -> tuple:
        node = self._or()
        if self.at < len(self.lexemes):
            raise TemplateError(f"unexpected {self.lexemes[self.at][1]!r}")
        return node

    def _take(self, *signs: str) -> str | None:
        if self.at < len(self.lexemes) and self.lexemes[self.at][0] == "sign" \
                and self.lexemes[self.at][1] in signs:
            self.at += 1
            return self.lexemes[self.at - 1][1]
        return None

    def _or(self) -> tuple:
        node = self._and()
        while self._take("or"):
            node = _fold(lambda a, b: a or b, node, self._and())
        return node

    def _and(self) -> tuple:
        node = self._not()
        while self._take("and"):
            node = _fold(lambda a, b: a and b, node, self._not())
        return node

    def _not(self) -> tuple:
        if self._take("not"):
            return _fold(lambda a: not a, self._not())
        node = self._sum()
        while sign := self._take("==", "!=", "in"):
            work = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b,
                    "in": lambda a, b: a in b}[sign]
            node = _fold(work, node, self._sum())
        return node

    def _sum(self) -> tuple:
        node = self._filtered()
        while sign := self._take("+", "~"):
            work = (lambda a, b: a + b) if sign == "+" else (lambda a, b: _text(a) + _text(b))
            node = _fold(work, node, self._filtered())
        return node

    def _filtered(self) -> tuple:
        node = self._atom()
        while self._take("|"):
            name = self._name()
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = _fold(_FILTERS[name], node)
        return node

    def _atom(self) -> tuple:
        if self._take("("):
            node = self._or()
            if not self._take(")"):
                raise TemplateError("missing )")
        elif self.at >= len(self.lexemes):
            raise TemplateError("missing value")
        else:
            kind, value = self.lexemes[self.at]
            self.at += 1
            if kind == "string":
                node = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]),
                                        value[1:-1]))
            elif kind == "number":
                node = ("const", int(value))
            elif kind == "name" and value in _CONSTANTS:
                node = ("const", _CONSTANTS[value])
            elif kind == "name":
                node = ("code", lambda scope, name=value: scope.get(name))
            else:
                raise TemplateError(f"unexpected {value!r}")
        while self._take("."):
            node = _fold(lambda v, name=self._name(): v.get(name) if isinstance(v, dict) else None, node)
        return node

    def _name(self) -> str:
        if self.at < len(self.lexemes) and self.lexemes[self.at][0] == "name":
            self.at += 1
            return self.lexemes[self.at - 1][1]
        raise TemplateError("missing name")


def _fold(work: Callable, *nodes: tuple) -> tuple:
    """A constant if all parts are, else a closure over the parts."""
    if all(kind == "const" for kind, _ in nodes):
        try:
            return ("const", work(*[v for _, v in nodes]))
        except (TypeError, ValueError, ArithmeticError) as error:
            raise TemplateError(f"bad constant: {error}") from error
    parts = [_closure(n) for n in nodes]
    if len(parts) == 1:
        return ("code", lambda scope, a=parts[0]: work(a(scope)))
    return ("code", lambda scope, a=parts[0], b=parts[1]: work(a(scope), b(scope)))


def _closure(node: tuple) -> Callable[[Scope], Any]:
    kind, value = node
    return value if kind == "code" else lambda scope: value


# ---------------------------------------------------------------- templates

# A hyphen inside a brace takes away the blanks and line ends on that side of the tag.
_TAGS = re.compile(
    r"\{\{(-?)(?P<value>.*?)(-?)\}\}|\{%(-?)(?P<tag>.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.DOTALL)


def _syntax(source: str) -> list[tuple]:
    """The tree: ('text', s), ('value', expr), ('if', [(expr, body)...]), ('for', name, expr,
    body), ('generation', body), ('set', name, expr)."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False

    def text(end: int, trim_end: bool) -> tuple[str, str]:
        found = source[at:end]
        found = found.lstrip() if trim else found
        return "text", found.rstrip() if trim_end else found

    for m in _TAGS.finditer(source):
        parts.append(text(m.start(), "-" in (m[1], m[4], m[7])))
        if m["value"] is not None:
            parts.append(("value", m["value"].strip()))
        elif m["tag"] is not None:
            parts.append(("tag", m["tag"].strip()))
        at, trim = m.end(), "-" in (m[3], m[6], m[8])
    parts.append(text(len(source), False))
    todo = iter([p for p in parts if p != ("text", "")])

    def block(*ends: str) -> tuple[list[tuple], str]:
        body: list[tuple] = []
        for kind, content in todo:
            word = content.split(None, 1)[0] if kind == "tag" else ""
            rest = content[len(word):].strip()
            if kind == "text":
                body.append(("text", content))
            elif kind == "value":
                body.append(("value", _Expression(content).parse()))
            elif word in ends:
                return body, content
            elif word == "if":
                arms, test = [], _Expression(rest).parse()
                while True:
                    inner, end = block("elif", "else", "endif")
                    arms.append((test, inner))
                    if end == "endif":
                        break
                    test = ("const", True) if end == "else" else _Expression(end[4:]).parse()
                body.append(("if", arms))
            elif word == "for":
                m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.DOTALL)
                if not m:
                    raise TemplateError(f"bad loop {rest!r}")
                body.append(("for", m[1], _Expression(m[2]).parse(), block("endfor")[0]))
            elif word == "generation":
                body.append(("generation", block("endgeneration")[0]))
            elif word == "set":
                name, _, value = rest.partition("=")
                body.append(("set", name.strip(), _Expression(value).parse()))
            else:
                raise TemplateError(f"unknown tag {content!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    return block()[0]


def _folded(body: list[tuple]) -> list[tuple]:
    """Constant values become text, constant branches are chosen, neighbouring text is joined."""
    out: list[tuple] = []
    for node in body:
        made = [node]
        if node[0] == "value" and node[1][0] == "const":
            made = [("text", _text(node[1][1]))]
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, _folded(inner)))
                if test[0] == "const":
                    break
            made = [("if", arms)] if arms and arms[0][0][0] != "const" else (arms[0][1] if arms else [])
        elif node[0] == "for":
            made = [("for", node[1], node[2], _folded(node[3]))]
        elif node[0] == "generation":
            made = [("generation", _folded(node[1]))]
        for part in made:
            if part[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + part[1])
            elif part != ("text", ""):
                out.append(part)
    return out


def _compile(body: list[tuple]) -> Renderer:
    steps = [_step(node) for node in body]

    def run(scope: Scope) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: tuple) -> Renderer:
    kind = node[0]
    if kind == "text":
        constant = (node[1], False)
        return lambda scope: iter((constant,))
    if kind == "value":
        value = _closure(node[1])
        return lambda scope: iter(((_text(value(scope)), False),))
    if kind == "set":
        name, value = node[1], _closure(node[2])

        def assign(scope: Scope) -> Iterator[tuple[str, bool]]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "generation":
        inside = _compile(node[1])
        return lambda scope: ((text, True) for text, _ in inside(scope))
    if kind == "if":
        arms = [(_closure(test), _compile(inner)) for test, inner in node[1]]

        def choose(scope: Scope) -> Iterator[tuple[str, bool]]:
            return next((inner(scope) for test, inner in arms if test(scope)), iter(()))

        return choose
    name, source, inner = node[1], _closure(node[2]), _compile(node[3])

    def loop(scope: Scope) -> Iterator[tuple[str, bool]]:
        items = iter(source(scope) or ())
        item, index = next(items, loop), 0  # the function itself marks the end
        while item is not loop:
            after = next(items, loop)
            state = {"first": not index, "last": after is loop, "index0": index, "index": index + 1}
            yield from inner({**scope, name: item, "loop": state})
            item, index = after, index + 1

    return loop


@lru_cache(maxsize=16)
def compile_template(source: str) -> Renderer:
    """A renderer: scope to a stream of (text, generated).

    Loops read their items one by one, so a conversation is never held as a whole.
    """
    return _compile(_folded(_syntax(source)))


# ---------------------------------------------------------------- on tables

PIECES = "conv_id long, piece int, text string, loss array<struct<start:int,stop:int>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, piece, text, loss): every conversation rendered, in pieces that follow each other.

    Turns are ordered by turn number (NULL first), role and text; NULL role and text are
    empty; rows with a NULL conv_id are one conversation; repeated rows are turns of their
    own; an empty table gives no rows. Other columns are not read. ``loss`` marks generated
    text by code points of the piece. Each partition streams through its sorted turns: a
    conversation of any length takes the memory of one piece and its longest text.
    """
    compile_template(template)
    base = boxed(turns, conv_id=number_id(conv_id), turn=field(turn).cast("long"),
                 role=F.coalesce(field(role).cast("string"), F.lit("")),
                 text=F.coalesce(field(text).cast("string"), F.lit(""))).drop("row")
    order = ["conv_id", "turn", "role", "text"]

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        for conv, messages in _by_conversation(_rows(batches)):
            buffer: list[str] = []
            loss: list[dict] = []
            size = number = 0
            for part, generated in run({"messages": messages}):
                if generated and part:
                    loss.append({"start": size, "stop": size + len(part)})
                buffer.append(part)
                size += len(part)
                if size >= PIECE_CHARS:
                    yield _piece(conv, number, buffer, loss)
                    buffer, loss, size, number = [], [], 0, number + 1
            for _ in messages:  # a template need not read all turns
                pass
            if size or not number:
                yield _piece(conv, number, buffer, loss)

    return base.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions(
        *order).mapInArrow(render, PIECES)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))


def _by_conversation(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, stream of messages); each stream must be read before the next is asked for."""
    row = next(rows, None)

    def messages(conv: int | None) -> Iterator[dict]:
        nonlocal row
        while row is not None and row[0] == conv:
            now, row = row, next(rows, None)
            yield {"role": now[1], "text": now[2]}

    while row is not None:
        yield row[0], messages(row[0])


def _piece(conv: int | None, number: int, buffer: list[str], loss: list[dict]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([conv], pa.int64()), pa.array([number], pa.int32()),
         pa.array(["".join(buffer)]), pa.array([loss], kind)], ["conv_id", "piece", "text", "loss"])


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


class Reader:
    """Reads turns and loss text back from the pieces of one conversation."""

    def __init__(self) -> None:
        self.rest = ""
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: list[dict]) -> None:
        self.formatted_chars += len(text)
        for span in loss:
            plain = unescape(text[span["start"]:span["stop"]])
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        text, at = self.rest + text, 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
            role = m.lastgroup if m["text"] is None else unescape(m["role"])
            content = m["text"] if m["text"] is not None else m[m.lastgroup]
            self.turns.update(f"{role}\n{unescape(content)}\n".encode())
            self.n_turns += 1
        self.rest = text[at:]

    def result(self, conv: int | None) -> tuple:
        if self.rest:
            raise ValueError("unfinished turn")
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests per conversation, read from the output of ``format_conversations`` (TEMPLATE).

    Works inside the partitions that the formatter left sorted, so nothing is shuffled again.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, started = Reader(), None, False
        done: list[tuple] = []
        for batch in batches:
            for conv, number, text, loss in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "piece", "text", "loss"))):
                if number == 0:
                    if started:
                        done.append(reader.result(current))
                    reader, current, started = Reader(), conv, True
                reader.feed(text, loss)
            if len(done) >= 1000:
                yield _digests(done)
                done = []
        if started:
            done.append(reader.result(current))
        if done:
            yield _digests(done)

    return pieces.mapInArrow(read, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
