"""Builders of transcript lines for tests."""

import json
import os


def claude(role, content, at="2031-04-05T06:07:08Z", sid="s1", cwd="/work/app"):
    return {"type": role, "sessionId": sid, "cwd": cwd, "timestamp": at, "message": {"role": role, "content": content}}


def use(call_id, command, name="Bash", **more):
    return {"type": "tool_use", "id": call_id, "name": name, "input": {"command": command} | more}


def result(call_id, content, **more):
    return {"type": "tool_result", "tool_use_id": call_id, "content": content} | more


def codex(kind, at="2031-04-05T06:07:08Z", envelope="response_item", **payload):
    return {"type": envelope, "timestamp": at, "payload": {"type": kind} | payload}


def write(path, lines, mtime):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines), encoding="utf-8")
    os.utime(path, (mtime, mtime))
    return path


def in_claude(home, name, lines, mtime):
    return write(home / ".claude/projects/p" / f"{name}.jsonl", lines, mtime)


def in_codex(home, name, lines, mtime):
    return write(home / ".codex/sessions" / f"{name}.jsonl", lines, mtime)
