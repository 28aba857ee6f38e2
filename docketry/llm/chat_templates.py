"""A compiler for a small template language that formats conversations.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python
closures. Templates reach only the names they are given: there are no calls, no attributes of
Python objects, no imports and no loops but over given lists. Text put out inside
``{% generation %}`` is recorded as a span, for the loss mask of training.

    {{ expression }}                          a value; `| escape` replaces control strings
    {% if expression %} {% elif expression %} {% else %} {% endif %}
    {% for name in expression %} {% endfor %}     with loop.first, loop.last, loop.index
    {% generation %} {% endgeneration %}
    expressions: 'text', numbers, names, name.key, + == != and or not ( )
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docketry.llm.common import prepare, read

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|([A-Za-z_]\w*)|(==|!=|[.+|()]))")


class TemplateError(ValueError):
    """The template is not in the language."""


# ---- syntax tree -------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Put:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple[tuple[Any, tuple], ...]


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parser ------------------------------------------------------------------------------


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            number, text, name, sign = m.groups()
            unescaped = None if text is None else re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text)
            self.tokens.append(("number", int(number)) if number else ("text", unescaped) if text is not None else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def whole(self) -> Any:
        out = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _take(self, *wanted: tuple[str, Any]) -> Any:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _chain(self, below: Callable[[], Any], *wanted: tuple[str, Any]) -> Any:
        left = below()
        while kind := self._take(*wanted):
            left = Op(kind, (left, below()))
        return left

    def _or(self) -> Any:
        return self._chain(self._and, ("name", "or"))

    def _and(self) -> Any:
        return self._chain(self._not, ("name", "and"))

    def _not(self) -> Any:
        return Op("not", (self._not(),)) if self._take(("name", "not")) else self._chain(self._sum, ("sign", "=="), ("sign", "!="))

    def _sum(self) -> Any:
        return self._chain(self._filtered, ("sign", "+"))

    def _filtered(self) -> Any:
        out = self._atom()
        while self._take(("sign", "|")):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in ("escape", "trim", "upper", "lower"):
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = Op(name, (out,))
        return out

    def _atom(self) -> Any:
        if self._take(("sign", "(")):
            out = self._or()
            if not self._take(("sign", ")")):
                raise TemplateError("a bracket stays open")
            return out
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind in ("number", "text"):
            return Const(value)
        if kind != "name" or value in ("and", "or", "not") or value.startswith("_"):
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return Const(value == "true")
        keys = []
        while self._take(("sign", ".")):
            kind, key = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or key.startswith("_"):
                raise TemplateError(f"no key {key!r}")
            keys.append(key)
            self.at += 1
        return Name(value, tuple(keys))


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts = [x for x in _TAG.split(template) if x]
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out: list[Any] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Put(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(statement(word, rest))
            else:
                out.append(Put(Const(part)))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(out), "", ""

    def statement(word: str, rest: str) -> Any:
        if word == "if":
            branches, test = [], _Expression(rest).whole()
            while True:
                body, end, rest = block("elif", "else", "endif")
                branches.append((test, body))
                if end == "endif":
                    return If(tuple(branches))
                test = _Expression(rest).whole() if end == "elif" else Const(True)
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            return For(m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


# ---- folding -----------------------------------------------------------------------------


def _apply(kind: str, values: list[Any], escape: Callable[[str], str]) -> Any:
    if kind == "+":
        return values[0] + values[1] if all(isinstance(v, int) and not isinstance(v, bool) for v in values) else _text(values[0]) + _text(values[1])
    if kind == "not":
        return not values[0]
    if kind in ("==", "!="):
        return (values[0] == values[1]) == (kind == "==")
    return {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}[kind](_text(values[0]))


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def fold(tree: tuple, escape: Callable[[str], str]) -> tuple:
    """The same template with constant expressions evaluated, dead branches gone and neighbouring texts joined."""

    def expression(e: Any) -> Any:
        if not isinstance(e, Op):
            return e
        parts = tuple(map(expression, e.parts))
        if e.kind in ("and", "or"):
            if isinstance(parts[0], Const):
                return parts[1] if bool(parts[0].value) == (e.kind == "and") else parts[0]
        elif all(isinstance(p, Const) for p in parts):
            return Const(_apply(e.kind, [p.value for p in parts], escape))
        return Op(e.kind, parts)

    out: list[Any] = []
    for node in tree:
        new: tuple = (node,)
        if isinstance(node, Put):
            new = (Put(expression(node.value)),)
        elif isinstance(node, Generation):
            new = (Generation(fold(node.body, escape)),)
        elif isinstance(node, For):
            new = (For(node.name, expression(node.over), fold(node.body, escape)),)
        elif isinstance(node, If):
            branches = []
            for test, body in ((expression(t), fold(b, escape)) for t, b in node.branches):
                if not isinstance(test, Const) or test.value:
                    branches.append((test, body))
                if isinstance(test, Const) and test.value:
                    break
            new = branches[0][1] if branches and isinstance(branches[0][0], Const) else (If(tuple(branches)),) if branches else ()
        for n in new:
            if isinstance(n, Put) and isinstance(n.value, Const) and out and isinstance(out[-1], Put) and isinstance(out[-1].value, Const):
                out[-1] = Put(Const(_text(out[-1].value.value) + _text(n.value.value)))
            else:
                out.append(n)
    return tuple(out)


# ---- closures ----------------------------------------------------------------------------


@dataclass
class Output:
    """What a rendering has put out so far: parts, their length, and the spans of generated text."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _closure(e: Any, escape: Callable[[str], str]) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda scope, v=e.value: v
    if isinstance(e, Name):

        def look(scope: dict) -> Any:
            value = scope.get(e.name)
            for key in e.keys:
                value = value.get(key) if isinstance(value, dict) else None
            return value

        return look
    parts = [_closure(p, escape) for p in e.parts]
    if e.kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if e.kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope: _apply(e.kind, [p(scope) for p in parts], escape)


def _body(tree: tuple, escape: Callable[[str], str]) -> Callable[[dict, Output], None]:
    steps = [_step(node, escape) for node in tree]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: Any, escape: Callable[[str], str]) -> Callable[[dict, Output], None]:
    if isinstance(node, Put):
        value = _closure(node.value, escape)
        return lambda scope, out: out.put(_text(value(scope)))
    if isinstance(node, Generation):
        body = _body(node.body, escape)

        def generate(scope: dict, out: Output) -> None:
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return generate
    if isinstance(node, If):
        branches = [(_closure(t, escape), _body(b, escape)) for t, b in node.branches]

        def choose(scope: dict, out: Output) -> None:
            for test, body in branches:
                if test(scope):
                    body(scope, out)
                    return

        return choose
    over, body = _closure(node.over, escape), _body(node.body, escape)

    def loop(scope: dict, out: Output) -> None:
        items = over(scope) or []
        for i, item in enumerate(items):
            body(scope | {node.name: item, "loop": {"first": i == 0, "last": i + 1 == len(items), "index": i + 1}}, out)

    return loop


class Template:
    """A compiled template; ``control`` are the strings that texts must not contain after ``escape``."""

    def __init__(self, source: str, control: tuple[str, ...]):
        self.control = control
        self._render = _body(fold(parse(source), self.escape), self.escape)

    def escape(self, text: str) -> str:
        """No control string stays, as a mark follows its first character; marks themselves are doubled."""
        out = text.replace(MARK, MARK + MARK)
        for c in self.control:
            out = out.replace(c, c[0] + MARK + "-" + c[1:])
        return out

    def render(self, **scope: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of it that {% generation %} made."""
        out = Output()
        self._render(scope, out)
        return "".join(out.parts), out.spans


def unescape(text: str) -> str:
    return re.sub(f"{MARK}(-|{MARK})", lambda m: MARK if m[1] == MARK else "", text)


# ---- conversations -----------------------------------------------------------------------

MARK = "␛"
BOT, EOT, OPEN, CLOSE, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]", "<|", "|>"
CONTROL = (OPEN, CLOSE, EOT, BOT, HEAD, TAIL)
#: One turn; a conversation of any length is rendered turn by turn.
TURN = (
    "{% if turn.role == 'user' %}[INST] {{ turn.text | escape }} [/INST]"
    "{% elif turn.role == 'assistant' %}<|assistant|>{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>"
    "{% else %}<|{{ turn.role | escape }}|>{{ turn.text | escape }}<s>{% endif %}"
)
#: A conversation whose turns are at hand at once; it puts out what its turns put out one after the other.
CONVERSATION = "{% for turn in turns %}" + TURN + "{% endfor %}"
#: One turn at the beginning of a text; escaped texts hold none of the strings between which they stand.
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<\|assistant\|>(?P<assistant>.*?)</s>|<\|(?!assistant\|>)(?P<role>.*?)\|>(?P<other>.*?)<s>", re.S)
#: Code points of formatted text from which a part of a conversation is closed.
PART = 1 << 20
EXTRA = (("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"))


def with_extra(conversations: DataFrame, conv_id: int = -1) -> DataFrame:
    """The conversations, and one whose texts are made of control strings."""
    spark = conversations.sparkSession
    rows = [(conv_id, i, role, text) for i, (role, text) in enumerate(EXTRA)]
    return conversations.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def render_turns(conversations: DataFrame) -> DataFrame:
    """Each row rendered: conv_id, turn, role, formatted, spans (flat: from, to in code points of formatted)."""
    prepare(conversations.sparkSession)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(TURN, CONTROL)
        for batch in batches:
            texts, spans = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out, where = template.render(turn={"role": role or "", "text": text or ""})
                texts.append(out)
                spans.append([x for s in where for x in s])
            columns = [*(batch.column(n) for n in ("conv_id", "turn", "role")), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "formatted", "spans"])

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(render, "conv_id long, turn long, role string, formatted string, spans array<int>")


def conversation_texts(rendered: DataFrame, part: int = PART) -> DataFrame:
    """The training text of each conversation: conv_id, part, text, spans (of generated text, counted from the part's start).

    Turns stand one after the other with nothing between. Texts of ``part`` code points or more
    continue in further parts, numbered from 0 and cut between turns.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["conv_id", "part", "text", "spans"], None

        def closed() -> pa.RecordBatch:
            columns = [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array(["".join(held[2])], pa.string()), pa.array([held[3]], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            done = []
            for conv_id, text, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "spans")), strict=True):
                if held is None or conv_id != held[0] or held[4] >= part:
                    if held:
                        done.append(closed())
                    held = [conv_id, held[1] + 1 if held and conv_id == held[0] else 0, [], [], 0]
                held[2].append(text)
                held[3] += [x + held[4] for x in spans]
                held[4] += len(text)
            yield from (b for b in pa.Table.from_batches(done).combine_chunks().to_batches()) if done else ()
        if held:
            yield closed()

    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.select("conv_id", "formatted", "spans").mapInArrow(join, "conv_id long, part int, text string, spans array<int>")


class TurnReader:
    """Reads a conversation's text back as it comes, in pieces cut anywhere: turns are found by the template's marks.

    Only an unfinished turn is held. Spans are counted from the start of the conversation, and
    come with the piece that they start in or later.
    """

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.turns, self.loss, self.loss_chars, self.chars = conv_id, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        self.rest, self.start, self.spans = "", 0, []

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.chars += len(text)
        self.spans += spans
        text, at = self.rest + text, 0
        while m := _TURN.match(text, at):
            role = m["role"] if m["role"] is not None else "user" if m["user"] is not None else "assistant"
            said = next(m[k] for k in ("user", "assistant", "other") if m[k] is not None)
            self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            self.n += 1
            end = self.start + m.end()
            while self.spans and self.spans[0][1] <= end:
                a, b = self.spans.pop(0)
                part = unescape(text[a - self.start : b - self.start])
                self.loss.update(part.encode())
                self.loss_chars += len(part)
            at = m.end()
        self.rest, self.start = text[at:], self.start + at

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"text after the last turn: {self.rest[:40]!r}")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(texts: DataFrame) -> DataFrame:
    """One row for each conversation, from its formatted text (conv_id, part, text, spans).

    A digest over a whole conversation needs its parts one after the other. They are sorted by
    Spark in conversation_texts, so that each task meets a conversation's parts in order; a task holds one part and one
    conversation's running digests, however many turns there are.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: TurnReader | None = None
        names = [x.split()[0] for x in READ_BACK.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema(list(zip(names, _KINDS, strict=True))))

        for batch in batches:
            done = []
            for conv_id, text, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "spans")), strict=True):
                if reader is None or conv_id != reader.conv_id:
                    if reader:
                        done.append(reader.row())
                    reader = TurnReader(conv_id)
                at = reader.chars
                reader.add(text, [(a + at, b + at) for a, b in zip(spans[::2], spans[1::2], strict=True)])
            yield batch_of(done)
        if reader:
            yield batch_of([reader.row()])

    return texts.select("conv_id", "text", "spans").mapInArrow(digest, READ_BACK)


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations formatted and read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of a conversation are taken by turn; rows that share a turn by role, then by text. A null
    text is an empty one, a null role an empty one; rows without conv_id are one conversation
    (null). Repeated rows are turns of their own. An empty table gives no rows; other columns are
    not read. A very long turn must fit a task; a conversation of very many turns is sorted by
    Spark and streamed through one task, in parts.
    """
    return read_back(conversation_texts(render_turns(conversations)))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(with_extra(read(spark, sf_dir, "conversations")))


def _escaped(c: str) -> str:
    out = f"replace({c}, '{MARK}', '{MARK}{MARK}')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}{MARK}-{x[1:]}')"
    return out


_MADE_OF = ", ".join(f"(-1, {i}, '{role}', '{text}')" for i, (role, text) in enumerate(EXTRA))
OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL (VALUES {_MADE_OF})),
f AS (SELECT *, length({_escaped("text")}) + CASE role WHEN 'user' THEN {len("[INST]  [/INST]")} WHEN 'assistant' THEN {len("<|assistant|></s>")} ELSE length({_escaped("role")}) + {len("<||><s>")} END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
