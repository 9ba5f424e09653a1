"""Transcripts as a stream: new files whole, and growing files line by line."""

import json
import os

import pytest
from test_sources import long_file
from transcripts import claude, codex, in_claude, in_codex, result, use, write

from tracemill.config import Settings
from tracemill.operators import evidence, normalize
from tracemill.sources import transcripts
from tracemill.streaming import growing
from tracemill.streaming.incremental import mine_new_files


def test_new_files_are_mined_once(spark, tmp_path):
    def one(name, n):
        lines = [claude("assistant", [use(f"c{k}", "harbor-pp-cli list")]) for k in range(n)] + [claude("user", [result("c0", "Exit code 1")])]
        write(tmp_path / "in/p" / f"{name}.jsonl", lines, 1_900_000_000 + n)

    seen = []

    def keep(found, index, number):
        seen.append((found.where("kind = 'tool_failure' AND list = 'cli'").count(), index.count()))

    one("a", 1)
    args = (spark, str(tmp_path / "in"), "claude", str(tmp_path / "checkpoint"), keep)
    mine_new_files(*args)
    one("b", 2)
    one("c", 3)
    mine_new_files(*args)
    mine_new_files(*args)
    assert seen == [(1, 1), (2, 2)]


def test_growing_files_equal_one_scan(spark, tmp_path):
    """Lines that arrive in three batches, cut anywhere, give the evidence of one scan over the whole files."""
    pytest.importorskip("google.protobuf")
    home = tmp_path / "home"
    texts = {}
    for dialect, put in (("claude", in_claude), ("codex", in_codex)):
        for n in range(2):
            name = f"{dialect}{n}"
            lines = long_file(100 + 60 * n) if dialect == "claude" else codex_file(80)
            texts[put(home, name, lines, 1_900_000_000 + n)] = None
    for path in texts:
        texts[path] = path.read_bytes()
    conf = {"spark.sql.streaming.stateStore.providerClass": growing.STORE}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for share in (0.3, 0.7, 1):
            for n, (path, whole) in enumerate(texts.items()):
                path.write_bytes(whole[: int(len(whole) * min(1, share * (1 + n % 2)))])
                os.utime(path, (1_900_000_000 + n, 1_900_000_000 + n))
            for source, under in transcripts.ROOTS if share != 0.7 else transcripts.ROOTS[:1]:
                growing.mine_growing(spark, str(home / under), source, str(tmp_path / source), str(tmp_path / "checkpoint" / source), stretch="700")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = [transcripts.choose(transcripts.discover(spark, [home]))]
    rows = normalize.with_context(normalize.normalized(transcripts.records(transcripts.read_lines(spark, found[0]))), Settings())
    want = evidence.evidence(rows, Settings()).drop("session_ord")
    got = growing.evidence_so_far(spark, str(tmp_path / "claude")).unionByName(growing.evidence_so_far(spark, str(tmp_path / "codex")))
    a, b = (sorted(tuple(map(str, r)) for r in df.select(*want.columns).collect()) for df in (got, want))
    assert len(b) > 150 and {"empty", "failure", "correction", "cli"} <= {r[0] for r in b}
    assert a == b
    lines = {r.path: r.lines for r in growing.files_so_far(spark, str(tmp_path / "claude")).collect()}
    assert lines == {str(p): t.count(b"\n") for p, t in texts.items() if "claude" in p.name}


def codex_file(n):
    out = [{"type": "session_meta", "payload": {"id": "cx", "cwd": "/w"}}]
    for k in range(n):
        at = f"2031-04-05T06:{k // 60:02}:{k % 60:02}Z"
        out.append(
            [
                codex("message", at, role="user", content=[{"type": "input_text", "text": ["go on", "no, that's wrong. Use the other one"][k % 2]}]),
                codex("function_call", at, name="shell", call_id=str(k % 7), arguments=json.dumps({"cmd": ["gamma-pp-cli list", "ls"][k % 2]})),
                codex("function_call_output", at, call_id=str((k - 1) % 7), output=["[]", "process exited with code 1"][k // 5 % 2]),
                codex("agent_message", at, message=["It returned no results.", "Next."][k // 5 % 2]),
                codex("custom_tool_call", at, name="exec", call_id=str(k % 7), input='await run({cmd: "delta-pp-cli get"})'),
            ][k % 5]
        )
    return out


def test_a_quiet_file_is_settled(spark, tmp_path):
    """What still waits for a step is dropped with the state, and the file starts anew if it grows again."""
    pytest.importorskip("google.protobuf")
    lines = [claude("assistant", [use("a", "alpha-pp-cli list")]), claude("user", [result("a", "[]")])]
    path = in_claude(tmp_path, "q", lines, 1_900_000_000)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, growing.STORE)
    args = (spark, str(tmp_path / ".claude"), "claude", str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    try:
        growing.mine_growing(*args, quiet_ms=1)
        other = in_claude(tmp_path, "other", lines[:1], 1_900_000_001)
        growing.mine_growing(*args, quiet_ms=1)
        with path.open("a") as f:
            f.write(json.dumps(claude("assistant", [{"type": "text", "text": "Next."}])) + "\n")
        growing.mine_growing(*args, quiet_ms=10**9)
    finally:
        spark.conf.set(key, before)
    assert growing.evidence_so_far(spark, str(tmp_path / "store")).where("list = 'empty'").count() == 0
    assert {r.path: r.lines for r in growing.files_so_far(spark, str(tmp_path / "store")).collect()} == {str(path): 1, str(other): 1}
