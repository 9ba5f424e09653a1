"""Settings of one scan: immutable, passed to every builder, so that scans in one process don't affect each other."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, replace

from tracemill import catalog


@dataclass(frozen=True)
class Settings:
    suffix: str = catalog.TRACKED_SUFFIX
    scaffold_markers: tuple[str, ...] = catalog.SCAFFOLD_MARKERS
    redactions: tuple[tuple[str, str], ...] = catalog.REDACTIONS
    backlog_ignore: frozenset[str] = catalog.BACKLOG_IGNORE
    remote_wrappers: frozenset[str] = catalog.REMOTE_WRAPPERS
    fetch_verbs: frozenset[str] = catalog.FETCH_VERBS
    empty_ignore: frozenset[str] = catalog.EMPTY_IGNORE
    subagent_failures: bool = False
    validate_candidates: bool = True
    detect_empty: bool = True
    full: bool = False

    @property
    def cli_name(self) -> str:
        """Pattern of a whole tracked name."""
        return rf"^[A-Za-z0-9][A-Za-z0-9._-]*{re.escape(self.suffix)}$"

    @property
    def cli_mention(self) -> str:
        """Pattern of a tracked name among other words."""
        return rf"(?<![\w.-])([A-Za-z0-9][A-Za-z0-9._-]*{re.escape(self.suffix)})(?=$|[\s;&|)])"

    def with_overrides(self, given: dict) -> Settings:
        """The settings of a configuration file; values of a wrong type are passed over, a bad pattern is reported."""
        out: dict = {}
        texts = lambda key: [str(x) for x in given[key]] if isinstance(given.get(key), list) else []
        if isinstance(given.get("tracked_cli_suffix"), str) and given["tracked_cli_suffix"]:
            out["suffix"] = given["tracked_cli_suffix"]
        out["scaffold_markers"] = self.scaffold_markers + tuple(m.lower() for m in texts("extra_scaffold_markers") if m)
        pairs = []
        for entry in given.get("extra_redaction_patterns") if isinstance(given.get("extra_redaction_patterns"), list) else []:
            if isinstance(entry, list) and len(entry) == 2:
                try:
                    re.compile(str(entry[0]))
                    pairs.append((str(entry[0]), str(entry[1])))
                except re.error as problem:
                    print(f"warning: bad redaction pattern {entry[0]!r}: {problem}", file=sys.stderr)
        out["redactions"] = self.redactions + tuple(pairs)
        out["backlog_ignore"] = self.backlog_ignore | set(texts("extra_backlog_ignore"))
        out["remote_wrappers"] = self.remote_wrappers | set(texts("extra_remote_command_wrappers"))
        out["fetch_verbs"] = self.fetch_verbs | {x.lower() for x in texts("silent_empty_fetch_verbs") if x}
        out["empty_ignore"] = self.empty_ignore | {x for x in texts("silent_empty_ignore") if x}
        for key, name in (("include_subagent_failures", "subagent_failures"), ("validate_pp_cli_candidates", "validate_candidates"), ("detect_silent_empty", "detect_empty")):
            if isinstance(given.get(key), bool):
                out[name] = given[key]
        return replace(self, **out)
