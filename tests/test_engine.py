"""Transcripts of both dialects through the whole engine: one home, mined once."""

import json
from pathlib import Path

import pytest
from transcripts import claude, codex, in_claude, in_codex, result, use

from pyspark.sql import functions as F

from tracemill import cli
from tracemill.config import Settings
from tracemill.operators import normalize
from tracemill.plans import scan
from tracemill.sources import transcripts

CLI = "harbor-pp-cli"


def talk(*blocks, **more):
    return claude("assistant", list(blocks), **more)


def back(*blocks, **more):
    return claude("user", list(blocks), **more)


def user(text, **more):
    return claude("user", text, **more)


SECRET = "sk-" + "a1B2" * 5


def fill(home: Path) -> None:
    t = 1_900_000_000
    # a failing tracked tool; blank and broken lines keep the numbering
    in_claude(home, "fails", [user("please run it"), "", "{broken", talk(use("c1", f"{CLI} list --token {SECRET}")), back(result("c1", "Exit code 1\nnot configured", is_error=True)), talk({"type": "text", "text": "hm"})], t)
    # server failures: three in two sessions
    for n in range(3):
        sid = f"m{n % 2}"
        in_claude(home, f"server{n}", [talk(use("q", "", f"mcp__ledger__get_{n}"), sid=sid), back(result("q", "Exit code 2"), sid=sid)], t + 1 + n)
    # corrections: with a skill before it, and without a skill
    in_claude(home, "skill", [user("do the report", sid="k"), talk(use("s", "", "Skill", skill="reporter"), sid="k"), back(result("s", "done"), sid="k"), user("no, that's wrong. Use the other one", sid="k")], t + 5)
    in_claude(home, "project", [user("go", sid="p", cwd="/work/tool"), talk({"type": "text", "text": "ok"}, sid="p", cwd="/work/tool"), user("Actually, use the blue one instead", sid="p", cwd="/work/tool"), user("<system-note> do not reply", sid="p", cwd="/work/tool")], t + 6)
    # three uses with different flags and no trouble otherwise
    in_claude(home, "retry", [line for n, flags in enumerate(("--a 1", "--b 2", "--a 1 --b 2")) for line in (talk(use(f"r{n}", f"kite-pp-cli show item {flags}"), sid="r"), back(result(f"r{n}", "fine"), sid="r"))], t + 7)
    # a timeout that isn't a failure; a command whose own text says timeout
    in_claude(home, "hang", [talk(use("h", "slow-pp-cli sync"), use("i", "timeout 9 calm-pp-cli sync"), sid="h"), back(result("h", "operation timed out"), result("i", "all good"), sid="h")], t + 8)
    # a swallowed empty result, one that was seen, one at the end
    in_claude(home, "empty", [talk(use("e", "mute-pp-cli list"), sid="e"), back(result("e", "[]"), sid="e"), talk({"type": "text", "text": "Next step."}, sid="e"), talk(use("f", "mute-pp-cli list"), sid="e"), back(result("f", "[]"), sid="e"), talk({"type": "text", "text": "It returned no results."}, sid="e"), talk(use("g", "mute-pp-cli list"), sid="e"), back(result("g", ""), sid="e")], t + 9)
    # an untracked program that keeps failing, in two sessions
    for n in range(3):
        sid = f"b{n % 2}"
        in_claude(home, f"backlog{n}", [talk(use("z", "cd /x && gizmo run"), sid=sid), back(result("z", "gizmo: command not found", is_error=True), sid=sid)], t + 10 + n)
    # slash commands in two sessions; one of several names alone
    in_claude(home, "slash1", [user("/polish now\n/lonely", sid="x1")], t + 14)
    in_claude(home, "slash2", [user("/polish again", sid="x2")], t + 15)
    # the other dialect: a loop over two tools of which one fails, code that runs a tool, an id used twice
    loop = "for c in north-pp-cli south-pp-cli; do $c doctor; done"
    in_codex(home, "rollout-2031-01-02T03-04-05", [
        {"type": "session_meta", "payload": {"id": "cx", "cwd": "/work/cx"}},
        codex("message", role="user", content=[{"type": "input_text", "text": "check all"}]),
        codex("function_call", name="shell", call_id="1", arguments=json.dumps({"cmd": loop})),
        codex("function_call_output", call_id="1", output="north-pp-cli ok\nall fine\nstill fine\nand more\nsouth-pp-cli\nFAIL not configured\nprocess exited with code 1"),
        codex("custom_tool_call", name="exec", call_id="2", input='const x = await run({cmd: "east-pp-cli get\\ntrue"}); // west-pp-cli is prose'),
        codex("custom_tool_call_output", call_id="2", output=[{"type": "output_text", "text": "process exited with code 3"}]),
    ], t + 16)
    # an orphan result and a string that reads like a flag
    in_claude(home, "odd", [back(result("nobody", "Exit code 1")), talk(use("o", "echo hi"), sid="o"), back(result("o", "fine", is_error="true"), sid="o")], t + 17)
    in_claude(home, "sub", [talk(use("y", "mcp", "mcp__side__get"), sid="y"), back(result("y", "Exit code 9"), sid="y")], t + 18)


@pytest.fixture(scope="module")
def mined(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    fill(home)
    files = transcripts.choose(transcripts.discover(spark, [home]))
    rows, found, index = scan.mine(transcripts.read_lines(spark, files), Settings())
    found, index = found.persist(), index.persist()
    got = scan.propose(spark, found, index, Settings(), "all").collect()
    return home, found.collect(), index.collect(), {(p.route, p.target_name): p for p in got}


def test_lines_keep_their_numbers(mined):
    failure = next(e for e in mined[1] if e.list == "failure" and e.path.endswith("fails.jsonl"))
    assert failure.line == 5 and failure.session_id == "s1" and failure.occurred_at == "2031-04-05T06:07:08+00:00"


def test_secrets_are_masked(mined):
    assert all(SECRET not in e.command + e.excerpt for e in mined[1])
    assert any("<redacted-" in e.command for e in mined[1])


def test_tracked_tools(mined):
    p = mined[3]
    tools = {n for r, n in p if r == "tool" and not n.startswith("mcp:")}
    assert tools == {CLI, "kite-pp-cli", "slow-pp-cli", "mute-pp-cli", "south-pp-cli", "east-pp-cli"}
    assert p["tool", CLI].summary == f"{CLI}: 1 failure signal(s) across 1 session(s)."
    assert "retried up to 3x" in p["tool", "kite-pp-cli"].summary
    assert "1 hang/timeout signal(s)" in p["tool", "slow-pp-cli"].summary
    assert "1 swallowed empty result(s)" in p["tool", "mute-pp-cli"].summary
    assert [e.kind for e in p["tool", "mute-pp-cli"].evidence][:1] == ["silent_empty"]


def test_servers_need_three_in_two_sessions(mined):
    p = mined[3]["tool", "mcp:ledger"]
    assert "3 failed tool call(s) across 2 session(s) (mcp__ledger__get_0, mcp__ledger__get_1, mcp__ledger__get_2)" in p.summary
    assert ("tool", "mcp:side") not in mined[3]


def test_corrections(mined):
    p = mined[3]
    assert [e.kind for e in p["skill_improvement", "reporter"].evidence] == ["skill_invocation", "user_correction"]
    memory = p["memory_context", "/work/tool"]
    assert memory.title == "Review durable corrections for tool" and [e.line for e in memory.evidence] == [3]


def test_backlog(mined):
    p = mined[3]["backlog", "gizmo"]
    assert p.summary == "gizmo had 3 command-interface failure(s) across 2 session(s)."


def test_content(mined):
    p = mined[3]
    slash = p["content_idea", "How I use /polish in real agent workflows"]
    assert "2 transcript signal(s) across 2 session(s)" in slash.summary and json.loads(slash.details)["confidence"] == 0.82
    assert not any("lonely" in n for _, n in p)
    top = p["content_idea", "The command-line stack I actually use to run agent workflows"]
    assert "mute-pp-cli (3)" in top.summary


def test_keys_follow_from_the_evidence(mined):
    import hashlib

    for p in mined[3].values():
        if p.route != "content_idea":
            parts = [p.route, p.target_kind, p.target_name, *(f"{e.source}:{e.path}:{e.line}:{e.kind}" for e in p.evidence)]
            assert p.proposal_key == hashlib.sha256("\0".join(parts).encode()).hexdigest()[:20]
    slash = mined[3]["content_idea", "How I use /polish in real agent workflows"]
    parts = ["content_idea", slash.title, *(f"{e.source}:{e.path}:{e.line}:{e.kind}" for e in slash.evidence)]
    assert slash.proposal_key == hashlib.sha256("\0".join(parts).encode()).hexdigest()[:20]


def test_session_index(mined):
    rows = {Path(r.path).stem: r for r in mined[2]}
    assert "odd" not in rows  # no signal
    assert rows["rollout-2031-01-02T03-04-05"].session_id == "cx" and rows["rollout-2031-01-02T03-04-05"].pp_cli_names == ["east-pp-cli", "north-pp-cli", "south-pp-cli"]
    assert rows["slash1"].slash_commands == ["lonely", "polish"]
    assert rows["project"].cwd == "/work/tool" and rows["project"].correction_count == 1


def test_one_file_in_many_splits(spark, tmp_path):
    """A file's lines are numbered right however it is cut, and what follows each line is found in one pass."""
    base, n = tmp_path / ".claude/projects/p", 20_000
    base.mkdir(parents=True)
    texts = [json.dumps({"type": "assistant", "message": {"role": "assistant", "content": f"step {k}"}}) if k % 3 else ["", "{broken", "é\x85\u2028 \x0b"][k // 3 % 3] for k in range(n)]
    (base / "long file+1.jsonl").write_bytes("\r\n".join(texts).encode() + b"\n\xff\n")
    (base / "short.jsonl").write_text(texts[1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
    try:
        for home in (tmp_path, tmp_path.as_uri()):
            files = transcripts.choose(transcripts.discover(spark, [home]))
            assert files.files.count() == 2
            lines = transcripts.read_lines(spark, files)
            got = {r.line: r.raw for r in lines.where("path LIKE '%long%'").collect()}
            assert sorted(got) == list(range(1, n + 2)) and [got[k + 1] for k in range(n)] == texts and got[n + 1] == "\ufffd"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = normalize.with_context(normalize.normalized(transcripts.records(lines)), Settings()).where("path LIKE '%long%'")
    nexts = {r.line: r.next for r in rows.select("line", F.col("next_step.line").alias("next")).collect()}
    steps = [k + 1 for k in range(n) if k % 3]
    assert nexts == dict(zip(steps, [*steps[1:], None], strict=True))
    assert transcripts.discover(spark, [f"{tmp_path.as_uri()}/none"]).files.count() == 0


def test_order_of_partitions_does_not_matter(spark, mined):
    home, _, _, before = mined
    files = transcripts.choose(transcripts.discover(spark, [home]))
    lines = transcripts.read_lines(spark, files).repartition(7)
    _, found, index = scan.mine(lines, Settings())
    after = scan.propose(spark, found, index, Settings()).collect()
    assert {p.proposal_key for p in after} == {p.proposal_key for p in before.values() if p.route != "content_idea"}


def test_scan_and_lifecycle(spark, mined, tmp_path, capsys):
    home, root = mined[0], tmp_path / "out"
    args = ["--home", str(home), "--output-root", str(root), "--config", str(tmp_path / "none.json"), "--all"]
    assert cli.main(args, spark) == 0
    said = capsys.readouterr().out
    staged = sorted(root.glob("proposals/*/*.json"))
    assert f"proposals={len(staged)}" in said and staged
    first = json.loads((root / "state.json").read_text())
    lines = [x for p in sorted((root / "session-index.jsonl").glob("part-*")) for x in p.read_text().splitlines()]
    packet = next((root / "review-packets").iterdir()).read_text()
    assert "## Session Index" in packet and f"### {staged[0].stem}" in packet
    # again: everything is seen, and no session is indexed twice
    assert cli.main([*args, "--dry-run"], spark) == 0
    again = json.loads(capsys.readouterr().out)
    assert again["proposal_count"] == 0 and len(lines) == again["sessions_with_signals"]
    # fixed before the evidence: a regression; ignored: suppressed
    base = ["--output-root", str(root)]
    assert cli.main([*base, "--resolve", f"tool:{CLI}", "--decision", "fixed", "--resolved-at", "2031-04-05T06:07:07Z", "--pr", "7"]) == 0
    assert cli.main([*base, "--resolve", "backlog:gizmo", "--decision", "ignored"]) == 0
    capsys.readouterr()
    assert cli.main([*args, "--dry-run", "--include-seen"], spark) == 0
    third = json.loads(capsys.readouterr().out)
    assert third["resolved_suppressed_targets"] == ["backlog:gizmo"] and third["regression_count"] == 1
    found = {f"{p['route']}:{p['target']['name']}": p for p in third["proposals"]}
    assert found[f"tool:{CLI}"]["regression"]["pr"] == "7" and "backlog:gizmo" not in found
    assert found["tool:mcp:ledger"]["recurrence"] == 2 and "previous run(s)" in found["tool:mcp:ledger"]["summary"]
    assert first["target_run_history"]["tool:mcp:ledger"] == [first["last_run_id"]]
    assert cli.main([*base, "--unresolve", "backlog:gizmo"]) == 0 and cli.main([*base, "--unresolve", "backlog:gizmo"]) == 2
