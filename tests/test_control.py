"""State, registry, decisions, configuration and the packet: all on the driver."""

import json
import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tracemill import cli
from tracemill.config import Settings
from tracemill.operators import content
from tracemill.plans import packet
from tracemill.plans.scan import Options, since
from tracemill.sources import control


def test_state_is_lenient_and_the_registry_strict(tmp_path):
    assert control.load_state(tmp_path)["seen_proposal_keys"] == [] and control.Registry.load(tmp_path).documents() == {}
    for broken in ("{", "[]"):
        (tmp_path / "state.json").write_text(broken)
        (tmp_path / "resolutions.json").write_text(broken)
        assert control.load_state(tmp_path)["seen_proposal_keys"] == []
        with pytest.raises(ValueError):
            control.Registry.load(tmp_path)


def test_resolutions_cut_the_history(tmp_path):
    runs = ["r1", "20310101T000000Z", "20310103T000000Z"]
    control.write_json(tmp_path / "state.json", {"target_run_history": {"tool:a": runs, "tool:b": runs[:2]}})
    entry = {"decision": "Fixed", "resolved_at": "2031-01-02T00:00:00Z"}
    target, known = control.Target.parse, control.Registry.load(tmp_path)
    known.record({target(t): control.Resolution.parse(entry) for t in ("tool:a", "tool:b")})
    assert control.load_state(tmp_path)["target_run_history"] == {"tool:a": runs[2:]}
    for broken in ({"decision": "maybe", "resolved_at": "2031-01-02"}, {"decision": "fixed"}, []):
        with pytest.raises(ValueError):
            control.Resolution.parse(broken)
    assert set(control.Registry.load(tmp_path).documents()) == {"tool:a", "tool:b"}
    with pytest.raises(ValueError):
        known.forget(target("tool:z"))
    known.forget(target("tool:a"))
    assert set(control.Registry.load(tmp_path).documents()) == {"tool:b"}


def test_decisions(tmp_path, capsys):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"decisions": [{"target": "tool:a", "decision": "wontfix"}, {"route_target": "backlog:b", "decision": "fixed", "resolved_at": "2031-01-01T00:00:00Z", "pr": 3}]}))
    assert cli.main(["--output-root", str(tmp_path), "--resolve-from", str(path), "--by", "me"]) == 0
    got = control.Registry.load(tmp_path).documents()
    assert got["tool:a"]["by"] == "me" and got["backlog:b"] == {"decision": "fixed", "resolved_at": "2031-01-01T00:00:00+00:00", "pr": "3", "note": "", "by": "me"}
    path.write_text(json.dumps({"decisions": [{"target": "tool:a", "decision": "fixed"}] * 2}))
    assert cli.main(["--output-root", str(tmp_path), "--resolve-from", str(path)]) == 2
    assert "duplicate" in capsys.readouterr().err
    for bad in ("tool", ":x", "tool:"):
        assert cli.main(["--output-root", str(tmp_path), "--resolve", bad, "--decision", "fixed"]) == 2


def test_settings(capsys):
    given = {"tracked_cli_suffix": "-tool", "extra_scaffold_markers": ["MARK"], "extra_redaction_patterns": [["z+", "<z>"], ["(", "x"], "no"], "extra_backlog_ignore": ["foo"], "include_subagent_failures": True, "detect_silent_empty": "no", "silent_empty_fetch_verbs": ["PULL"]}
    got = Settings().with_overrides(given)
    assert got.suffix == "-tool" and "mark" in got.scaffold_markers and got.redactions[-1] == ("z+", "<z>") and "foo" in got.backlog_ignore
    assert got.subagent_failures and got.detect_empty and "pull" in got.fetch_verbs and "warning" in capsys.readouterr().err
    assert Settings() == Settings().with_overrides({})


def test_window(tmp_path):
    options = Options((tmp_path,), tmp_path)
    assert since(Options((tmp_path,), tmp_path, everything=True), {}) is None
    assert control.iso(since(options, {"last_scan_started_at": "2031-01-01T00:00:00Z"})) == "2031-01-01T00:00:00+00:00"


def test_source_tree(tmp_path):
    for place in ("library/a", "manuscripts/a", "manuscripts/b"):
        (tmp_path / place).mkdir(parents=True)
    tree = dict(control.source_tree(tmp_path, "-pp-cli"))
    assert tree["a-pp-cli"].endswith("library/a") and tree["b-pp-cli"].endswith("manuscripts/b")
    assert control.source_tree(tmp_path / "none", "-pp-cli") is None


def test_packet():
    evidence = [{"kind": "k", "path": "/p", "line": n, "command": "c" if n else "", "excerpt": "e"} for n in range(12)]
    idea = {"proposal_id": "content-1", "title": "t", "route": "content_idea", "target": {"kind": "a", "name": "b"}, "summary": "s", "suggested_action": "x", "evidence": evidence}
    page = packet.render("r", [], 0, [idea], ["w"], [{"target": "tool:z"}], [], False)
    assert page.count("  - `k`") == 8 and "PARSER WARNING: w" in page and "`tool:z`" in page and "## Content privacy notice" in page
    assert "unredacted" in packet.render("r", [], 0, [], full=True) and "No proposals met" in packet.render("r", [], 0, [])


def test_wrapper(tmp_path):
    """The script finds the package from any folder; the registry needs no Spark session."""
    script = Path(cli.__file__).resolve().parent.parent / "bin" / "tracemill"
    got = subprocess.run(["sh", str(script), "--output-root", str(tmp_path), "--list-resolutions"], cwd=tmp_path, env=os.environ | {"TRACEMILL_PYTHON": sys.executable}, capture_output=True, text=True)
    assert got.returncode == 0 and json.loads(got.stdout) == {}


@pytest.mark.parametrize("private", [False, True])
def test_content_documents(private):
    details = dict.fromkeys((c.split(" ")[0] for c in content.DETAILS.split(", ")), "x") | {"confidence": 0.725, "private": private}
    got = content.content_document(SimpleNamespace(details=json.dumps(details), summary="s"), {"schema_version": 1})
    assert got["confidence"] == 0.72 and got["schema_version"] == 1 and got["trigger"]["real_workflow_or_moment"] == "s"
    assert got["privacy"]["risk_level"] == ("high" if private else "low") and ("address books" in got["privacy"]["blocked_details"]) == private
    assert {"content_type", "recommendation", "audience", "why_interesting", "reader_usefulness", "timeliness", "last30days", "rough_outline", "review", "apply_policy"} <= set(got)
