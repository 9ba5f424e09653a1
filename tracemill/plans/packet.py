"""The review packet: a Markdown page for the person who decides."""

from __future__ import annotations

from tracemill import catalog

EVIDENCE_FIELDS = ["source", "path", "line", "session_id", "kind", "tool_name", "command", "occurred_at", "excerpt"]
SAFE = "Excerpts here are masked and cut short, and transcripts are named, not copied, so an agent may review this page."
FULL = "This page was made with --full: excerpts are whole and unredacted. Keep it on this machine."
RULES = (
    "Nothing here has been applied, and nothing is to be until somebody has said yes to it.",
    "Ask of each proposal whether it would help next month, or only explains last Tuesday.",
    "Where a skill covers the subject already, add to it; a new one needs a reason.",
    "A tool that failed in real use is mended where its source is, by the usual way of changing it.",
    "A machine that was down or a login that ran out is no rule to remember.",
)
#: Headings, which other tools look for, are fixed values.
TITLE, HEADS = "# Daily Improvement Review Packet", {"rules": "## Rules", "summary": "## Summary", "again": "## Regressions re-opened after a fix", "proposals": "## Proposals", "privacy": "## Content privacy notice", "sessions": "## Session Index"}


def render(run_id: str, sessions: list[dict], n_sessions: int, proposals: list[dict], warnings=(), suppressed=(), regressions=(), full: bool = False) -> str:
    targets = ", ".join(f"`{t}`" for t in sorted({s["target"] for s in suppressed})) or "none"
    summary = [f"Sessions with signals: {n_sessions}", f"New proposals: {len(proposals)}", f"Held back because they were settled before: {len(suppressed)} ({targets})", f"Settled before, but seen again since: {len(regressions)}", *(f"PARSER WARNING: {w}" for w in warnings)]
    parts = [
        section(f"{TITLE} ({run_id})", [FULL if full else SAFE]),
        section(HEADS["rules"], [bullets(RULES)]),
        section(HEADS["summary"], [bullets(summary)]),
        section(HEADS["again"], ["\n".join(map(regression_line, regressions)) or "None."]),
        section(HEADS["proposals"], [proposal_text(p) for p in proposals] or ["No proposals met the counts that are asked for."]),
    ]
    if any(p["route"] == "content_idea" for p in proposals):
        parts.append(section(HEADS["privacy"], [catalog.PRIVACY_NOTICE]))
    parts.append(section(HEADS["sessions"], ["\n".join(map(session_line, sessions[: catalog.PACKET_SESSIONS]))]))
    return "\n\n".join(parts).rstrip() + "\n"


def section(head: str, blocks: list[str]) -> str:
    return "\n\n".join([head, *blocks])


def bullets(lines) -> str:
    return "\n".join(f"- {x}" for x in lines)


def regression_line(p: dict) -> str:
    r = p["regression"]
    return f"- `{p['proposal_id']}` `{r['target']}`: seen at {r['latest_evidence_at']}, after {r['pr'] or 'a change without a number'} of {r['fixed_at']}."


def evidence_line(e: dict) -> str:
    command = f" command=`{e['command']}`" if e.get("command") else ""
    return f"  - `{e['kind']}` {e['path']}:{e['line']}{command} - {e['excerpt']}"


def proposal_text(p: dict) -> str:
    facts = (("Route", f"`{p['route']}`"), ("Target", f"`{p['target']['kind']}:{p['target']['name']}`"), ("Summary", p["summary"]), ("Suggested action", p["suggested_action"]))
    lines = [f"- {k}: {v}" for k, v in facts] + ["- Evidence:", *map(evidence_line, p["evidence"][: catalog.PACKET_EVIDENCE])]
    return f"### {p['proposal_id']} - {p['title']}\n\n" + "\n".join(lines)


def session_line(s: dict) -> str:
    names = lambda k: ",".join(s[k]) or "-"
    return f"- `{s['source']}` `{s['session_id']}` tools={s['tool_call_count']} pp={names('pp_cli_names')} skills={names('skill_names')} failures={s['failure_count']} corrections={s['correction_count']}"
