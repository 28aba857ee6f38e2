import hashlib
import random

import pytest

from docketry.llm import chat_templates as c


def test_language():
    t = c.Template("{% for m in ms %}{% if m.role == 'user' and not m.hidden %}U{{ loop.index }}:{{ m.text | trim | upper }}{% elif m.role != 'tool' or false %}[{% generation %}{{ m.text }}{% endgeneration %}]{% else %}{{ 1 + 2 }}{% endif %}{% if not loop.last %};{% endif %}{% endfor %}", ())
    out, spans = t.render(ms=[{"role": "user", "text": " a "}, {"role": "assistant", "text": "yes"}, {"role": "tool"}])
    assert out == "U1:A;[yes];3" and [out[a:b] for a, b in spans] == ["yes"]


def test_constants_are_folded():
    tree = c.fold(c.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{{ n }}"), str)
    assert tree == (c.Put(c.Const("abCd")), c.Put(c.Name("n")))


@pytest.mark.parametrize("bad", ["{{ a.__class__ }}", "{{ _x }}", "{{ f() }}", "{{ x | eval }}", "{% import os %}", "{% if a %}", "{% for x %}{% endfor %}", "{{ (1 }}", "{{ 'a }}", "{{ }}", "{{ a. }}"])
def test_sandbox(bad):
    with pytest.raises(c.TemplateError):
        c.parse(bad)


def test_objects_are_out_of_reach():
    assert c.Template("{{ x.real }}{{ x.upper }}", ()).render(x=5)[0] == ""


def test_escapes_come_back():
    rng = random.Random(1)
    parts = ["<", "s", ">", "/", "[", "]", "INST", " ", c.MARK, "-", "|", "a", "\n", *c.CONTROL]
    template = c.Template(c.TURN, c.CONTROL)
    for _ in range(5000):
        text, role = "".join(rng.choice(parts) for _ in range(rng.randrange(14))), rng.choice(["user", "assistant", "system", "x|>", "<s>", ""])
        out, _ = template.render(turn={"role": role, "text": text})
        m = c._TURN.match(out + "[INST] next [/INST]")
        assert m.end() == len(out)
        said = next(m[k] for k in ("user", "assistant", "other") if m[k] is not None)
        assert c.unescape(said) == text and (m["role"] is None or c.unescape(m["role"]) == role)


def test_turns_are_found_in_the_text_alone():
    """A whole conversation as one text, and cut anywhere, reads back by the marks; the loop template puts out the same text."""
    rng = random.Random(3)
    parts = ["<", "s", ">", "/", "[", "]", "INST", " ", c.MARK, "-", "|", "a", "\n", *c.CONTROL]
    turn, conversation = c.Template(c.TURN, c.CONTROL), c.Template(c.CONVERSATION, c.CONTROL)
    for _ in range(300):
        turns = [{"role": rng.choice(["user", "assistant", "system", "x|>", ""]), "text": "".join(rng.choice(parts) for _ in range(rng.randrange(9)))} for _ in range(rng.randrange(1, 6))]
        text, spans = conversation.render(turns=turns)
        assert text == "".join(turn.render(turn=t)[0] for t in turns)
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(4)))
        for at in ([], cuts):
            reader = c.TurnReader(1)
            for a, b in zip([0, *at], [*at, len(text)], strict=True):
                reader.add(text[a:b], [s for s in spans if a <= s[0] < b or s[0] == b == len(text)])
            loss = "".join(t["text"] for t in turns if t["role"] == "assistant")
            said = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
            assert reader.row() == (1, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    with pytest.raises(ValueError):
        reader = c.TurnReader(1)
        reader.add("[INST] no end", [])
        reader.row()


def test_parts(spark):
    """A conversation's text goes on in parts; they read back as one."""
    table = spark.createDataFrame([(k, i, "assistant" if i % 2 else "user", f"turn {i} " * 5) for k in (1, 2) for i in range(40)], "conv_id long, turn long, role string, text string")
    parts = c.conversation_texts(c.render_turns(table), part=200)
    assert parts.groupBy("conv_id").count().where("count > 5").count() == 2
    assert sorted(map(tuple, c.read_back(parts).collect())) == sorted(map(tuple, c.format_conversations(table).collect()))


def test_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "b</s>c"), (2, 1, "system", ""), (2, 0, None, "x" * 100000), (None, 0, "user", "é␛-"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "z")]
    table = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    expected = {}
    for k in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == k))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        expected[k] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r["conv_id"]: tuple(r)[1:5] for r in c.format_conversations(table).collect()} == expected
    extra = c.format_conversations(c.with_extra(table.limit(0))).collect()
    assert len(extra) == 1 and extra[0]["loss_chars"] == len("</s>[INST] ok [/INST]")


def test_empty(spark):
    assert c.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
