"""Redaction, shortening, times and detectors on single values."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tracemill import catalog
from tracemill.config import Settings
from tracemill.functions import text as tx
from tracemill.functions.patterns import java, replace_all
from tracemill.sources import control


def ask(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in rows.orderBy("n").select(f(F.col("v"))).collect()]


def secrets():
    """Assembled here, so that none stands in the file."""
    x = "aB3" * 20
    yield from ("me.you@mail.example.org", "Authorization: " + "Bearer " + x, "cookie: " + "a=1; b=2", "api_key=" + x[:12], "s" + "k-" + x[:20], "AK" + "IA" + "ABCD1234" * 2)
    yield from ("client_secret: " + x[:9], "r" + "k_live_" + x[:16], "wh" + "sec_" + x[:16], "xo" + "xb-" + x[:12], "AI" + "za" + x[:35], "np" + "m_" + x[:30], "gl" + "pat-" + x[:20], "gh" + "p_" + x[:20])
    yield from ("github" + "_pat_" + x[:20], "ey" + "J" + x[:20] + "." + x[:20] + "." + x[:10], "+1 415-555-0199", "-----BEGIN RSA PRIVATE" + " KEY-----\nab\n-----END RSA PRIVATE" + " KEY-----", "bearer " + x[:24], x[:56])


def by_hand(text):
    for pattern, by in catalog.REDACTIONS:
        text = re.sub(pattern, by, text)
    return text


def test_redaction_agrees_with_the_rules_in_order(spark):
    texts = [f"é see {s}, ok" for s in secrets()] + ["nothing here", "", "a b $1 \\1"]
    got = ask(spark, texts, tx.redact)
    assert got == [by_hand(t) for t in texts]
    assert all(s not in g for s, g in zip(secrets(), got, strict=False))
    assert ask(spark, texts[:2], lambda c: tx.redact(c, Settings(full=True))) == texts[:2]


def test_patterns_read_unicode_as_python_does(spark):
    texts = ["a b", "x\rACTUALLY y", "x\nactually y", "Été don't do", "ſ"]
    for pattern in (r"\s+", catalog.WEAK_CUE, catalog.STRONG_CUE, r"^\w+$"):
        assert ask(spark, texts, lambda c, p=pattern: F.regexp_count(c, F.lit(java(p))) > 0) == [bool(re.search(pattern, t)) for t in texts]
    assert ask(spark, ["k=v"], lambda c: replace_all(c, r"(k)=(v)", r"\1$\2")) == ["k$v"]


def test_shorten(spark):
    assert ask(spark, [" a \n b ", "x" * 360, "x" * 361, "y" * 358 + " " + "z" * 9, None], tx.shorten) == ["a b", "x" * 360, "x" * 359 + "...", "y" * 358 + "...", ""]


@pytest.mark.parametrize("value", ["2031-01-02T03:04:05Z", "2031-01-02T03:04:05.5+02:00", "2031-01-02T03:04:05", "1900000000", "1900000000000", "yesterday", "", None])
def test_times(spark, value):
    single = value if value is None or not value.isdigit() else int(value)
    want = control.parse_time(single)
    got = ask(spark, [value], lambda c: tx.iso(tx.parse_time(c)))[0]
    assert got == (control.iso(want) if want else "")
    assert ask(spark, ["/x/rollout-2031-01-02T03-04-05-abc.jsonl"], tx.path_time)[0].replace(tzinfo=None) == dt.datetime(2031, 1, 2, 3, 4, 5)


def test_executables(spark):
    commands = ["", "env X=1 foo", "A=1 b c", "/usr/bin/foo x && bar", "time go", "cd /x && gizmo run", "grep x | head", "-v y; tool z", "const x = 1"]
    assert ask(spark, commands, tx.executable) == ["", "X=1", "b", "foo", "go", "cd", "grep", "-v", "const"]
    assert ask(spark, commands, lambda c: tx.blamed_executable(c, catalog.BACKLOG_IGNORE)) == ["", "X=1", "b", "foo", "go", "gizmo", "", "tool", ""]


def test_empty_payloads(spark):
    outputs = ["", "[]", "{}\n", "0 rows", "(0 rows)", "No results.", "[1]", "Script completed\nWall time 1s\nOutput:\n", "process exited with code 0\nfinal output:\nnull"]
    assert ask(spark, outputs, tx.empty_payload) == ["(empty stdout)", "[]", "{}", "0 rows", "(0 rows)", "No results.", None, "(empty stdout)", "null"]


def test_corrections(spark):
    texts = ["that's wrong, redo", "Actually, use X", "how do we actually do it", "do not " + "x" * 500, "<tag> you missed it", "you missed it " + "x" * 1500, "[00:01] instead [00:02] b", "x" * 400 + " you missed it", "tool mapping: you missed it"]
    assert ask(spark, texts, lambda c: tx.is_correction(c, F.lit("/a.jsonl"), Settings())) == [True, True, False, False, False, True, False, False, False]
    assert ask(spark, texts[:1], lambda c: tx.is_correction(c, F.lit("/subagents/a.jsonl"), Settings())) == [False]


def test_polymorphic_texts(spark):
    import json

    values = ["plain", ["a", {"type": "text", "text": "b"}, {"type": "image"}, {"type": "text", "text": ""}], {"text": "t"}, None, 5]
    rows = [json.dumps({"c": v}) for v in values]
    of = lambda f: lambda c: f(tx.field(F.parse_json(c), "c"))
    assert ask(spark, rows, of(tx.message_text)) == ["plain", "a\nb", "", "", ""]
    assert ask(spark, rows, of(tx.output_text)) == ["plain", "ab", "t", "", "5"]
    flags = [json.dumps({"c": v}) for v in (True, False, "true", None, 1)]
    from tracemill.operators.normalize import _flag

    assert ask(spark, flags, of(_flag)) == [True, False, None, None, None]
