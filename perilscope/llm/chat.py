"""Chat formatting by templates, compiled to Python closures.

The template language has ``{{ expression }}``, ``{% for x in messages %}``, ``{% if %}`` with
``elif`` and ``else``, ``{% set x = expression %}``, and ``{% generation %}`` around what a
model is to learn. Expressions know texts, integers, ``true``, ``false`` and ``none``, fields
(``m.role``, ``m['role']``), ``+``, ``==``, ``!=``, ``in``, ``not``, ``and``, ``or`` and the
filters ``escape``, ``trim``, ``upper``, ``lower`` and ``length``. There are no calls, and names and
fields are looked up in the messages alone, so a template reaches nothing of Python. Within
a loop, ``loop.first``, ``loop.last`` and ``loop.index`` are set.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm.frames import col_of

#: Marks of the template below; a text that holds one is escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}"
    "{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<s>[ROLE] {{ m.role | escape }} [TEXT] {{ m.text | escape }} [/ROLE]"
    "{% endif %}{% endfor %}"
)
Piece = tuple[str, bool]
FILTERS = ("escape", "trim", "upper", "lower", "length")


class TemplateError(ValueError):
    """A template that cannot be compiled, or an operation it must not do."""


class Escape:
    """Reversible escaping of control strings.

    A backslash goes behind the first character of each control string, and behind that of
    anything that looks like an escaped one, so that no text yields a control string.
    """

    def __init__(self, controls: Sequence[str]):
        for c in controls:
            if len(c) < 2 or any(d[0] in c[1:] for d in controls) or "\\" in c:
                raise TemplateError(f"control string {c!r} cannot be escaped")
        each = "|".join(
            f"(?<={re.escape(c[0])})\\\\*{re.escape(c[1:])}" for c in sorted(controls, key=len)
        )
        self._plain = re.compile(f"(?:{each})") if controls else None
        self._escaped = (
            re.compile(each.replace("\\\\*", "\\\\+")) if controls else None
        )

    def add(self, text: str) -> str:
        return self._plain.sub(lambda m: "\\" + m[0], text) if self._plain else text

    def remove(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][1:], text) if self._escaped else text


# ---- parsing: a template becomes a tree of tuples whose first element is the kind of node

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKENS = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.\[\]()+]))"
)
_WORDS = {"true": True, "false": False, "none": None}
_UNQUOTE = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        found = _TOKENS.match(source, at)
        if not found:
            raise TemplateError(f"cannot read {source[at:].strip()!r}")
        out.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression, from ``or`` down to fields."""

    def __init__(self, source: str):
        self.source, self.left = source, _tokens(source)

    def parse(self) -> tuple:
        node = self.either()
        if self.left:
            raise TemplateError(f"{self.left[0][1]!r} is too much in {self.source!r}")
        return node

    def take(self, *values: str) -> str | None:
        if self.left and self.left[0][0] != "str" and self.left[0][1] in values:
            return self.left.pop(0)[1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while op := self.take("==", "!=", "in"):
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.field()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            node = ("filter", name, node)
        return node

    def name(self) -> str:
        if not self.left or self.left[0][0] != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        return self.left.pop(0)[1]

    def field(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = ("field", node, ("value", self.name()))
            else:
                node = ("field", node, self.either())
                self.need("]")
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if not self.left:
            raise TemplateError(f"{self.source!r} ends too early")
        kind, value = self.left.pop(0)
        if kind == "str":
            body = re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), value[1:-1], flags=re.S)
            return ("value", body)
        if kind == "int":
            return ("value", int(value))
        if kind == "name":
            return ("value", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError(f"{value!r} is out of place in {self.source!r}")


def parse(template: str) -> list[tuple]:
    """The tree of a template: a list of nodes."""
    parts, at = [], 0
    for tag in _TAGS.finditer(template):
        parts += [("text", template[at : tag.start()])]
        parts += [("show", tag[1])] if tag[1] is not None else [("tag", tag[2].strip())]
        at = tag.end()
    parts.append(("text", template[at:]))

    def block(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        while parts:
            kind, body = parts.pop(0)
            if kind == "text":
                nodes += [("text", body)] if body else []
                continue
            if kind == "show":
                nodes.append(("show", _Expression(body).parse()))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return nodes, body
            if word == "for":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not found:
                    raise TemplateError(f"cannot read {body!r}")
                inner, _ = block("endfor")
                nodes.append(("for", found[1], _Expression(found[2]).parse(), inner))
            elif word == "if":
                nodes.append(branches(rest))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"cannot read {body!r}")
                nodes.append(("set", name.strip(), _Expression(value).parse()))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return nodes, ""

    def branches(condition: str) -> tuple:
        test = _Expression(condition).parse()
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", test, then, [branches(end[4:])])
        return ("if", test, then, block("endif")[0] if end == "else" else [])

    return block()[0]


# ---- constants are worked out, and dead branches and neighbouring texts go

def _as_text(value: object) -> str:
    return "" if value is None else str(value)


def _operate(op: str, a: object, b: object) -> object:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return _as_text(a) in _as_text(b)
    return a + b if isinstance(a, int) and isinstance(b, int) else _as_text(a) + _as_text(b)


def _filters(escape: Escape) -> dict[str, Callable[[object], object]]:
    return {
        "escape": lambda v: escape.add(_as_text(v)),
        "trim": lambda v: _as_text(v).strip(),
        "upper": lambda v: _as_text(v).upper(),
        "lower": lambda v: _as_text(v).lower(),
        "length": lambda v: len(_as_text(v)),
    }


def fold(node: tuple, escape: Escape) -> tuple:
    """An expression with all parts that are the same for every conversation worked out."""
    kind, rest = node[0], [fold(n, escape) if isinstance(n, tuple) else n for n in node[1:]]
    known = [n[1] for n in rest if isinstance(n, tuple) and n[0] == "value"]
    if kind in ("==", "!=", "in", "+") and len(known) == 2:
        return ("value", _operate(kind, *known))
    if kind == "not" and known:
        return ("value", not known[0])
    if kind == "filter" and known:
        return ("value", _filters(escape)[rest[0]](known[0]))
    if kind in ("and", "or") and rest[0][0] == "value":
        return rest[1] if bool(rest[0][1]) == (kind == "and") else rest[0]
    return (kind, *rest)


def fold_block(nodes: list[tuple], escape: Escape) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "show":
            node = ("show", fold(node[1], escape))
            if node[1][0] == "value":
                node = ("text", _as_text(node[1][1]))
        elif kind == "set":
            node = ("set", node[1], fold(node[2], escape))
        elif kind == "for":
            node = ("for", node[1], fold(node[2], escape), fold_block(node[3], escape))
        elif kind == "generation":
            node = ("generation", fold_block(node[1], escape))
        elif kind == "if":
            test = fold(node[1], escape)
            yes, no = fold_block(node[2], escape), fold_block(node[3], escape)
            if test[0] == "value":
                for chosen in yes if test[1] else no:
                    add(chosen)
                continue
            node = ("if", test, yes, no)
        add(node)
    return out


# ---- closures: one for each node, over the closures of its parts

def _expression(node: tuple, escape: Escape) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "value":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "filter":
        use, inner = _filters(escape)[node[1]], _expression(node[2], escape)
        return lambda scope: use(inner(scope))
    parts = [_expression(n, escape) for n in node[1:]]
    first, second = parts[0], parts[-1]
    if kind == "field":
        def field(scope: dict) -> object:
            holder = first(scope)
            return holder.get(second(scope)) if type(holder) is dict else None
        return field
    if kind == "not":
        return lambda scope: not first(scope)
    if kind == "and":
        return lambda scope: first(scope) and second(scope)
    if kind == "or":
        return lambda scope: first(scope) or second(scope)
    return lambda scope: _operate(kind, first(scope), second(scope))


def _loop(name: str, over: Callable, body: Callable) -> Callable:
    def run(scope: dict, learn: bool) -> Iterator[Piece]:
        items = over(scope)
        if items is None or isinstance(items, (str, int, dict)):
            raise TemplateError("a loop needs a list of messages")
        missing, index, left = object(), 0, iter(items)
        item = next(left, missing)
        while item is not missing:
            after = next(left, missing)
            index += 1
            loop = {"first": index == 1, "last": after is missing, "index": index}
            yield from body({**scope, name: item, "loop": loop}, learn)
            item = after
    return run


def _block(nodes: list[tuple], escape: Escape) -> Callable[[dict, bool], Iterator[Piece]]:
    steps: list[Callable] = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda scope, learn, t=node[1]: ((t, learn),))
        elif kind == "show":
            value = _expression(node[1], escape)
            steps.append(lambda scope, learn, v=value: ((_as_text(v(scope)), learn),))
        elif kind == "set":
            value = _expression(node[2], escape)

            def assign(scope, learn, n=node[1], v=value):
                scope[n] = v(scope)
                return ()
            steps.append(assign)
        elif kind == "generation":
            steps.append(lambda scope, learn, b=_block(node[1], escape): b(scope, True))
        elif kind == "if":
            test = _expression(node[1], escape)
            yes, no = _block(node[2], escape), _block(node[3], escape)
            steps.append(lambda s, learn, t=test, y=yes, n=no: (y if t(s) else n)(s, learn))
        else:
            steps.append(_loop(node[1], _expression(node[2], escape), _block(node[3], escape)))

    def run(scope: dict, learn: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, learn)
    return run


def compile_template(
    template: str, controls: Sequence[str] = CONTROLS
) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from the messages of a conversation to pieces ``(text, learn)``.

    Messages are read one by one and pieces come as they are made, so a conversation of any
    length takes the memory of its longest message. Raises TemplateError for faulty templates.
    """
    escape = Escape(controls)
    run = _block(fold_block(parse(template), escape), escape)
    return lambda messages: run({"messages": messages}, False)


# ---- Spark

PIECES = "piece bigint, text string, learn boolean"


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with an equal first column, across batches."""
    rows = (
        row
        for batch in batches
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True)
    )
    return groupby(rows, key=lambda row: row[0])


def _rows(rows: Iterable[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of about ``size`` characters at most."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 64 + sum(len(v) for v in row if isinstance(v, str))
        if chars >= size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema
            )
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema
        )


def format_conversations(
    df: DataFrame,
    template: str = TEMPLATE,
    controls: Sequence[str] = CONTROLS,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    batch_chars: int = 4_000_000,
) -> DataFrame:
    """The formatted conversations in pieces: ``id``, ``piece``, ``text``, ``learn``.

    The pieces of a conversation stand one after the other in one partition; joined in the
    order of ``piece`` they are the formatted text, and ``learn`` marks what counts for the
    loss. Turns go by ``turn``, null first, then by role and text. Null roles and texts are empty.
    Rows without an id are one conversation. A conversation is formatted as a stream and never
    held as a whole.
    """
    compile_template(template, controls)  # faults show before a job starts
    base = df.select(
        col_of(id).alias("_id"),
        F.coalesce(col_of(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col_of(text).cast("string"), F.lit("")).alias("text"),
        col_of(turn).alias("_turn"),
    )
    ordered = base.repartition("_id").sortWithinPartitions("_id", "_turn", "role", "text")
    id_type = df.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        first = next(batches := iter(batches), None)
        if first is None:
            return
        schema = pa.schema(
            [("_id", first.schema.types[0]), ("piece", pa.int64()), ("text", pa.string()),
             ("learn", pa.bool_())]
        )

        def pieces() -> Iterator[tuple]:
            from itertools import chain

            for conversation, rows in _conversations(chain([first], batches)):
                messages = ({"role": r[1], "text": r[2]} for r in rows)
                for number, (piece, learn) in enumerate(render(messages)):
                    yield conversation, number, piece, learn

        yield from _rows(pieces(), schema, batch_chars)

    return ordered.select("_id", "role", "text").mapInArrow(
        run, f"_id {id_type}, {PIECES}"
    ).withColumnRenamed("_id", id)


def read_turns(pieces: Iterable[Piece], escape: Escape) -> Iterator[tuple[str, str, str]]:
    """The turns ``(role, text, learnt text)`` in the output of ``TEMPLATE``, one at a time."""
    held, learnt = "", ""

    def turn() -> tuple[str, str, int] | None:
        if held.startswith("<s>[INST] "):
            end = held.find("[/INST]", 10)
            return ("user", held[10 : end - 1], end + 7) if end > 0 else None
        if held.startswith("<s>[ROLE] "):
            middle, end = held.find("[TEXT]", 10), held.find("[/ROLE]", 10)
            return (
                (held[10 : middle - 1], held[middle + 7 : end - 1], end + 7) if end > 0 else None
            )
        end = held.find("</s>")
        return ("assistant", held[:end], end + 4) if end >= 0 else None

    for piece, learn in pieces:
        held += piece
        if learn:
            learnt += piece
            continue
        # a turn ends with a mark of the template, never within a text
        while held and piece.endswith((">", "]")) and (found := turn()):
            role, text, end = found
            yield escape.remove(role), escape.remove(text), escape.remove(learnt)
            held, learnt = held[end:], ""
    if held:
        raise TemplateError(f"{held[:40]!r} is no whole turn")


def read_back(pieces: DataFrame, id: str = "conv_id", controls: Sequence[str] = CONTROLS) -> DataFrame:
    """What stands in the formatted conversations, one row each, read from the pieces alone.

    Columns: the id, ``n_turns``, ``turns_sha256`` of role, line break, text, line break of
    all turns, ``loss_chars`` and ``loss_sha256`` of the unescaped text that counts for the
    loss, ``formatted_chars``. ``pieces`` must come from ``format_conversations`` with
    ``TEMPLATE``, whose partitions hold whole conversations in order.
    """
    id_type = pieces.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        from itertools import chain

        escape = Escape(controls)
        first = next(batches := iter(batches), None)
        if first is None:
            return
        schema = pa.schema(
            [(id, first.schema.types[0]), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
             ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
             ("formatted_chars", pa.int64())]
        )

        def conversations() -> Iterator[tuple]:
            for conversation, rows in _conversations(chain([first], batches)):
                chars = 0

                def counted() -> Iterator[Piece]:
                    nonlocal chars
                    for _, _, text, learn in rows:
                        chars += len(text)
                        yield text, learn

                turns, loss, n, loss_chars = sha256(), sha256(), 0, 0
                for role, text, learnt in read_turns(counted(), escape):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    loss.update(learnt.encode("utf-8", "surrogatepass"))
                    n, loss_chars = n + 1, loss_chars + len(learnt)
                yield conversation, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _rows(conversations(), schema, 1_000_000)

    return pieces.select(id, "piece", "text", "learn").mapInArrow(
        run,
        f"`{id}` {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint",
    )
