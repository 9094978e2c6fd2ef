"""Template compiler and chat formatting."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from perilscope.llm import chat

TEXT = st.text(st.sampled_from("<>[]/\\sINSTROLEX ab\né"), max_size=30)


def render(template, messages, controls=chat.CONTROLS):
    return list(chat.compile_template(template, controls)(messages))


def joined(template, messages):
    return "".join(t for t, _ in render(template, messages))


def test_expressions_and_blocks():
    messages = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "Yo"}]
    template = (
        "{% set a = 'x' + 'y' %}{{ a }}{% for m in messages %}"
        "{% if loop.first and not loop.last %}[first]{% endif %}{{ m['role'] | upper }}:"
        "{{ m.text | trim }}{{ m.none_such }}{% if m.role in 'assistants' or false %}!{% endif %}"
        "{{ loop.index + 1 }};{% endfor %}"
    )
    assert joined(template, messages) == "xy[first]USER:Hi2;ASSISTANT:Yo!3;"


def test_constants_are_folded():
    escape = chat.Escape(chat.CONTROLS)
    tree = chat.fold_block(
        chat.parse("a{{ 'b' | upper }}{% if 1 == 1 and not false %}c{% else %}{{ m }}{% endif %}d"),
        escape,
    )
    assert tree == [("text", "aBcd")]


@pytest.mark.parametrize(
    "template",
    ["{% for x %}", "{% if a %}", "{{ a b }}", "{{ }}", "{{ f() }}", "{% include x %}",
     "{{ a | nosuch }}", "{% for m in messages %}{% endif %}", "{{ 'a }}", "{{ a.__class__( }}"],
)
def test_faulty_templates(template):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)


def test_nothing_of_python_is_reached():
    template = "{% for m in messages %}{{ m.__class__ }}{{ m.text.upper }}{% endfor %}{{ print }}"
    assert joined(template, [{"role": "u", "text": "t"}]) == ""
    with pytest.raises(chat.TemplateError):
        render("{% for c in 'abc' %}{{ c }}{% endfor %}", [])


def test_generation_marks():
    pieces = render(chat.TEMPLATE, [{"role": "assistant", "text": "a</s>"}])
    assert pieces == [("a<\\/s>", True), ("</s>", False)]


@given(TEXT)
def test_escapes_are_reversible(text):
    escape = chat.Escape(chat.CONTROLS)
    assert escape.remove(escape.add(text)) == text
    assert not any(c in escape.add(text) for c in chat.CONTROLS)


def test_controls_that_cannot_be_escaped():
    with pytest.raises(chat.TemplateError):
        chat.Escape(["<a<b>"])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b"]), TEXT)))
def test_turns_are_read_back(turns):
    messages = ({"role": r, "text": t} for r, t in turns)
    pieces = chat.compile_template(chat.TEMPLATE)(messages)
    found = list(chat.read_turns(pieces, chat.Escape(chat.CONTROLS)))
    assert [(r, t) for r, t, _ in found] == turns
    assert [s for _, _, s in found] == [t if r == "assistant" else "" for r, t in turns]


def test_streams_are_lazy():
    def messages():
        yield {"role": "user", "text": "a"}
        yield {"role": "user", "text": "b"}
        raise RuntimeError("read too far")

    stream = chat.compile_template(chat.TEMPLATE)(messages())
    assert next(stream) == ("<s>[INST] ", False)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string"


def expected(turns):
    turns_text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(turns_text), len(loss), sha(loss)


def test_format_and_read_back(spark):
    rows = [
        (1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (2, 0, None, "t", None),
        (None, 0, "user", "n", ""), (None, None, "assistant", "</s>", ""),
        (3, 0, "assistant", "same", ""), (3, 0, "assistant", "same", ""),
        (4, 0, "assistant", "é" * 50_000, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r[0]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert found == {
        1: expected([("user", None), ("assistant", "b")]),
        2: expected([(None, "t")]),
        None: expected([("assistant", "</s>"), ("user", "n")]),
        3: expected([("assistant", "same")] * 2),
        4: expected([("assistant", "é" * 50_000)]),
    }


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(empty)).collect() == []


def test_long_conversations_come_in_batches():
    schema = pa.schema([("a", pa.int64()), ("t", pa.string())])
    sizes = [b.num_rows for b in chat._rows(((i, "x" * 100) for i in range(100)), schema, 1000)]
    assert sum(sizes) == 100 and max(sizes) < 10
