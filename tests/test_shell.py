"""The shell tokenizer, against cases and noise."""

import random

import pytest

from tracemill.config import Settings
from tracemill.functions.shell import Shell, is_code, literals, program, split_words, without_heredocs

shell = Shell(Settings())


@pytest.mark.parametrize(
    ("command", "names"),
    [
        ("alpha-pp-cli list", ["alpha-pp-cli"]),
        ("X=1 env Y=2 /opt/bin/alpha-pp-cli list", ["alpha-pp-cli"]),
        ("echo alpha-pp-cli", []),
        ("echo 'run alpha-pp-cli'; beta-pp-cli x", ["beta-pp-cli"]),
        ("true\nalpha-pp-cli x", ["alpha-pp-cli"]),
        ("a | alpha-pp-cli && beta-pp-cli || c", ["alpha-pp-cli", "beta-pp-cli"]),
        ("ssh host 'alpha-pp-cli list'", ["alpha-pp-cli"]),
        ("ssh a \"ssh b 'alpha-pp-cli x'\"", ["alpha-pp-cli"]),
        ("cat <<EOF\nalpha-pp-cli\nEOF\nbeta-pp-cli", ["beta-pp-cli"]),
        ("for c in alpha-pp-cli beta-pp-cli; do $c doctor; done", ["alpha-pp-cli", "beta-pp-cli"]),
        ("for c in alpha-pp-cli; do echo no; done", []),
        ("source kssh; kssh_once 'alpha-pp-cli x'", ["alpha-pp-cli"]),
        ("alpha-pp-cli 'unclosed", ["alpha-pp-cli"]),
    ],
)
def test_names(command, names):
    assert shell.of_call("shell", command) == names


def test_code():
    code = '// note\nconst x = run({"cmd": "alpha-pp-cli get\\nbeta-pp-cli set", note: "gamma-pp-cli"})'
    assert is_code(code) and not is_code("constant x")
    assert shell.of_call("program", code) == ["alpha-pp-cli", "beta-pp-cli"]
    assert shell.of_call("program", "alpha-pp-cli x") == ["alpha-pp-cli"]
    assert literals("command: 'a\\tb'") == ["a\tb"]
    assert shell.sole_command(code) == "alpha-pp-cli get\nbeta-pp-cli set"
    assert shell.sole_command("const a = {cmd: 'x'}, b = {cmd: 'y'}") == ""


def test_shapes():
    assert shell.shapes("alpha-pp-cli get item --a=1 -b 2; alpha-pp-cli get item -b", "alpha-pp-cli") == [("get item", ("--a", "-b")), ("get item", ("-b",))]


@pytest.mark.parametrize(
    ("tool", "command", "wants"),
    [
        ("mcp__x__get_rows", "", True), ("mcp__x__delete_rows", "", False), ("Bash", "curl https://x", True), ("Bash", "curl -d a https://x", False), ("Bash", "gh api /x", True),
        ("Bash", "foo list", True), ("Bash", "foo list; bar", False), ("Bash", "foo list > out", False), ("Bash", "foo delete list", False), ("Bash", "foo --json", True), ("Bash", "grep --json x", False),
        ("Bash", "foo -q list", False), ("Bash", "foo -X POST list", False), ("Bash", "psql -c 'select 1'", True), ("Bash", "ls", False), ("Bash", "", False),
    ],
)
def test_wants_data(tool, command, wants):
    assert shell.wants_data(tool, command, False) is wants


def test_programs():
    assert [program(c) for c in ("", "env X=1 foo", "A=1 b", "/usr/bin/foo x && bar", "  time  go")] == ["", "X=1", "b", "foo", "go"]
    assert without_heredocs("a <<X\nb\n") == "a <<X\n"


def test_never_raises():
    rng = random.Random(7)
    parts = ["alpha-pp-cli", "'", '"', "<<EOF\n", "EOF", "\n", ";", "$(", "\\", "for x in a; do", "done", "ssh ", "const x = {cmd: `", "`", " ", "\t", "é", "|", "--json", "="]
    for _ in range(2000):
        command = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        names = shell.of_call("program", command)
        assert names == sorted(set(names))
        split_words(command), shell.shapes(command, "alpha-pp-cli"), shell.wants_data("Bash", shell.sole_command(command), bool(names))
