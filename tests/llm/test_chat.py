"""The template language and the chat format."""

import hashlib

import pytest

from tidemark.llm.chat import TURNS, Const, Out, TemplateError, compile_template, digests, escape, fold, formatted, parse, read_turns, unescape


def _render(source, messages=(), **env):
    return "".join(text for text, _ in compile_template(source)(list(messages)))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"), ("{{ 'x' ~ 2 }}", "x2"), ("{% if 1 == 2 %}a{% elif not false %}b{% else %}c{% endif %}", "b"), ("{# no #}x", "x"), ("a  {{- 'b' -}}  c", "abc"),
        ("{% set x = 'q' | upper %}{{ x }}{{ y }}", "Q"), ("{{ 'a' if none else 'b' }}", "b"), ("{% for m in messages %}{{ loop.index }}{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}", "1u,2v"),
        ("{{ messages[1].t }}{{ messages | length }}", "v2"), ("{{ y is defined }}{{ messages is not defined }}", "FalseFalse"), ("{{ 'a' in 'cat' and 3 not in messages }}", "True"), ("{{ z | default('d') }}", "d"), ("{{ -3 + 5 }}", "2"),
    ],
)
def test_render(source, want):
    assert _render(source, [{"t": "u"}, {"t": "v"}]) == want


@pytest.mark.parametrize("source", ["{% for %}", "{% if x %}", "{{ f(1) }}", "{{ x | unknown }}", "{{ 'a", "{% bad %}", "{{ }}", "{% endfor %}", "{{ 1 2 }}", "{{ x"])
def test_errors(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@pytest.mark.parametrize("source", ["{{ messages.__class__ }}", "{{ ''.__class__.__mro__ }}", "{% for m in messages %}{{ m.__init__ }}{% endfor %}"])
def test_sandbox(source):
    assert _render(source, [{"t": "u"}]) == ""
    with pytest.raises(TemplateError):
        _render("{{ 'a' * 1000000000 }}")


def test_fold():
    assert fold(parse("a{{ 'b' ~ 1 }}{% if true %}c{% else %}{{ x }}{% endif %}{% if false %}d{% endif %}")) == (Out(Const("ab1c")),)


def test_streams():
    """Turns are rendered as they come, without holding the conversation."""

    def endless():
        while True:
            yield {"role": "user", "text": "x"}

    pieces = compile_template(TURNS)(endless())
    assert "".join(next(pieces)[0] for _ in range(10)).startswith("<turn user>\nx</turn>\n<turn user>\nx")


def test_escape():
    for text in ("", "\\", "</turn>", "\\### Assistant: </turn> ok", "<turn a>\n\\<", "a>b\\>"):
        assert unescape(escape(text)) == text and "<" not in escape(text).replace("\\<", "")


def test_read_back(spark):
    rows = [(1, 1, "assistant", "two </turn>\n<turn user>"), (1, 0, "user", "one\\"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 0, "assistant", "a" * 300_000), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, None, "we>ird\n", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = {r.conv_id: r for r in digests(formatted(df)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len("<turn >\n</turn>\n") + len(escape(a)) + len(escape(b)) for a, b in turns)
    assert len(found) == len(by) and digests(formatted(df.limit(0))).count() == 0
    with pytest.raises(ValueError, match="inside"):
        list(read_turns(["<turn a>\nb"]))
