import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import chat
from provspark.llm.template import Const, Out, TemplateError, Text, compile_template, fold, parse


def said(template, messages, **names):
    return "".join(p for p, _ in template.render(messages, **names))


def test_language():
    t = compile_template("{% for m in messages %}{% if loop.first %}<{% elif m.role == 'x' %}!{% else %},{% endif %}{{ loop.index }}{{ m.text | upper }}{% if loop.last %}>{% endif %}{% endfor %}")
    assert said(t, [{"role": "a", "text": "p"}, {"role": "x", "text": "q"}, {"role": "b", "text": None}]) == "<1P!2Q,3>"
    assert said(compile_template("{% set a = 2 + 3 * 2 %}{{ a }} {{ 'y' if a > 7 else 'n' }} {{ not a == 8 and true }}{# gone #}"), []) == "8 y False"
    assert said(compile_template("a  {%- if true -%}  b  {% endif %}c"), []) == "ab  c"
    assert said(compile_template("{{ name ~ 1 }}"), [], name="n") == "n1"


def test_folding():
    assert fold(parse("a{{ 1 + 1 }}b{% if 1 > 2 %}no{% else %}c{% endif %}", {}), {}) == (Text("a2bc"),)
    (out,) = fold(parse("{{ x ~ (2 * 3) }}", {}), {})
    assert isinstance(out, Out) and out.value.args[1] == Const(6)


@pytest.mark.parametrize("bad", ["{{ _x }}", "{{ m.__class__ }}", "{{ f(1) }}", "{% import os %}", "{{ x | eval }}", "{% for x in y %}", "{{ 1 + }}", "{% if x %}", "{{ @ }}"])
def test_refused_when_compiled(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


@pytest.mark.parametrize("bad", ["{{ unknown }}", "{{ messages.append }}", "{% for c in 'text' %}{% endfor %}", "{{ 'a' * 1000000 }}"])
def test_refused_when_rendered(bad):
    with pytest.raises(TemplateError):
        said(compile_template(bad), [])


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("<s>/[]INSTURX|\\. a") + ["é"]), max_size=60))
def test_escape_is_undone(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in chat.CONTROLS)


def read(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", chat.F.lit("clash"))
    return {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_rows(spark):
    big = [(9, i, "assistant" if i % 2 else "user", "[INST]" * 50) for i in range(3000)]
    got = read(spark, [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a[TEXT]"), (2, None, None, None), (None, 0, "assistant", "x"), (3, 0, "user", ""), (3, 0, "user", ""), *big])
    assert got[1]["turns_sha256"] == digest("user\na[TEXT]\nassistant\nb</s>\n") and got[1]["loss_sha256"] == digest("b</s>") and got[1]["loss_chars"] == 5
    assert got[2]["turns_sha256"] == digest("\n\n") and got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == digest("")
    assert got[None]["loss_chars"] == 1
    assert got[3]["n_turns"] == 2
    assert got[9]["n_turns"] == 3000 and got[9]["loss_chars"] == 1500 * 300
    assert read(spark, []) == {}
