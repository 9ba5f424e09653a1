"""Redaction, shortening, times and the texts of polymorphic fields."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import catalog
from tracemill.config import Settings
from tracemill.functions.patterns import java, matches, replace_all

ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), java(r"\s+"), " "))


def shorten(text: Column, limit: int = catalog.EXCERPT_CHARS, settings: Settings = Settings()) -> Column:
    """At most ``limit`` code points, or one less and three dots."""
    limit = max(limit, catalog.FULL_CHARS) if settings.full else limit
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("...")))


#: What a text must hold for a rule to match anywhere: one of some words (in lower case where case is ignored), or a
#: shorter pattern. Rules from a configuration have no such guard.
GUARDS: dict[str, tuple[str, tuple[str, ...]]] = dict(
    zip(
        (pattern for pattern, _ in catalog.REDACTIONS),
        (
            ("words", ("@",)),
            ("lower", ("authorization:",)),
            ("lower", ("cookie:",)),
            ("lower", ("key", "token", "secret", "password", "cookie")),
            ("words", ("sk-",)),
            ("words", ("AKIA",)),
            ("lower", ("secret", "token")),
            ("words", ("k_live_", "k_test_")),
            ("words", ("whsec_",)),
            ("words", ("xox",)),
            ("words", ("AIza",)),
            ("words", ("npm_",)),
            ("words", ("glpat-",)),
            ("words", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
            ("words", ("github_pat_",)),
            ("words", ("eyJ",)),
            ("pattern", (r"\d{3}[\s.-]?\d{4}",)),
            ("words", ("PRIVATE KEY-----",)),
            ("lower", ("bearer",)),
            ("pattern", (r"[A-Za-z0-9_+/=-]{56}",)),
        ),
        strict=True,
    )
)


def _may_match(text: Column, guard: tuple[str, tuple[str, ...]]) -> Column:
    kind, needed = guard
    if kind == "pattern":
        return matches(text, needed[0])
    return _holds(F.lower(F.upper(text)), needed) if kind == "lower" else _holds(text, needed)


def _holds(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs in the text, which is worked out once."""
    return F.exists(F.array(text), lambda t: reduce(operator.or_, map(t.contains, words)))


def _any_may_match(text: Column, guards: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
    """Whether any guard may hold: its words in any case, or its pattern. If none does, no rule changes the text."""
    words = {w.lower() for kind, needed in guards if kind != "pattern" for w in needed}
    patterns = {needed[0] for kind, needed in guards if kind == "pattern"}
    return reduce(operator.or_, (matches(text, p) for p in sorted(patterns)), _holds(F.lower(F.upper(text)), sorted(words)))


def _guarded(pattern: str, by: str, guard: tuple[str, tuple[str, ...]]) -> Callable[[Column], Column]:
    return lambda text: F.when(_may_match(text, guard), replace_all(text, pattern, by)).otherwise(text)


def redact(text: Column, settings: Settings = Settings(), guards: dict[str, tuple[str, tuple[str, ...]]] = GUARDS) -> Column:
    """All rules in their order; nothing under ``full``. A rule runs where its guard holds, and none where no guard does.

    Each rule is a function of one variable, so that the plan holds every pattern once.
    """
    whole = F.coalesce(text, F.lit(""))
    if settings.full:
        return whole
    if all(pattern in guards for pattern, _ in settings.redactions):
        used = [guards[pattern] for pattern, _ in settings.redactions]
        return F.get(F.transform(F.array(whole), lambda t: F.when(_any_may_match(t, used), _redacted(t, settings, guards)).otherwise(t)), F.lit(0))
    return _redacted(whole, settings, guards)


def _redacted(out: Column, settings: Settings, guards: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    for pattern, by in settings.redactions:
        if pattern in guards:
            out = F.get(F.transform(F.array(out), _guarded(pattern, by, guards[pattern])), F.lit(0))
        else:
            out = replace_all(out, pattern, by)
    return out


def strip(text: Column) -> Column:
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")


def parse_time(value: Column) -> Column:
    """ISO 8601 text (without a zone: UTC) or a number of seconds, or of milliseconds beyond 10**10; else null."""
    text = F.trim(value)
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$") & ~text.rlike(r"^\d{8}$"), F.try_to_number(text, F.lit("9" * 20)).cast("double"))
    number = F.coalesce(number, F.when(text.rlike(r"^-?\d+\.\d+$"), text.try_cast("double")))
    stamp = F.when(text.rlike(r"^\d{4}-?\d{2}-?\d{2}"), F.try_to_timestamp(text))
    return F.when(number.isNotNull(), F.timestamp_micros((F.when(number > 1e10, number * 1e3).otherwise(number * 1e6)).cast("long"))).otherwise(stamp)


def iso(time: Column) -> Column:
    return F.coalesce(F.date_format(F.date_trunc("second", time), ISO), F.lit(""))


def path_time(path: Column) -> Column:
    """The time that a file's name carries."""
    part = lambda n: F.regexp_extract(path, java(catalog.PATH_TIME), n)
    return F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("Z")))


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, … of a variant; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def is_kind(value: Column, kind: str) -> Column:
    """kind: OBJECT, ARRAY, STRING or BOOLEAN; no other kind's name begins so."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def field(value: Column, name: str) -> Column:
    """A field of a variant; null if it is missing or the variant is no object."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def text_of(value: Column) -> Column:
    """A variant as text if it is anything but empty, zero, false or null; else null."""
    return F.get(F.filter(F.array(F.try_variant_get(value, "$", "string")), lambda t: ~t.isin("", "0", "false", "null", "[]", "{}", "0.0")), F.lit(0))


def items(value: Column) -> Column:
    return F.when(is_kind(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def object_of(text_or_object: Column) -> Column:
    """An object, or the object that a string holds as JSON; else null."""
    parsed = F.try_parse_json(F.when(is_kind(text_or_object, "STRING"), F.try_variant_get(text_or_object, "$", "string")))
    return F.when(is_kind(text_or_object, "OBJECT"), text_or_object).when(is_kind(parsed, "OBJECT"), parsed)


def _joined(value: Column, kinds: tuple[str, ...], separator: str, keep_empty: bool, second: str | None = None) -> Column:
    """The texts of a list's blocks of certain kinds and of its bare strings."""

    def one(block: Column) -> Column:
        own = F.try_variant_get(field(block, "text"), "$", "string")
        if second:
            own = F.coalesce(F.nullif(own, F.lit("")), F.try_variant_get(field(block, second), "$", "string"))
        fits = F.coalesce(F.try_variant_get(field(block, "type"), "$", "string").isin(*kinds), F.lit(False))
        return F.when(is_kind(block, "STRING"), F.try_variant_get(block, "$", "string")).when(fits, F.coalesce(own, F.lit("")))

    texts = F.filter(F.transform(items(value), one), lambda t: t.isNotNull() & (F.lit(keep_empty) | (t != "")))
    return F.array_join(texts, separator)


def message_text(content: Column) -> Column:
    """A string as it is; of a list the text blocks and bare strings, by line."""
    whole = F.when(is_kind(content, "STRING"), F.try_variant_get(content, "$", "string"))
    return F.coalesce(whole, _joined(content, ("text",), "\n", False), F.lit(""))


def result_text(content: Column) -> Column:
    whole = F.when(is_kind(content, "STRING"), F.try_variant_get(content, "$", "string"))
    return F.coalesce(whole, _joined(content, ("text", "tool_result"), "\n", False, "content"), F.lit(""))


def output_text(value: Column) -> Column:
    """Blocks run together; of an object its text or output; other values as text."""
    whole = F.when(is_kind(value, "STRING"), F.try_variant_get(value, "$", "string"))
    of_object = F.coalesce(text_of(field(value, "text")), text_of(field(value, "output")), F.lit(""))
    listed = F.when(is_kind(value, "ARRAY"), _joined(value, ("input_text", "output_text", "text"), "", True))
    rest = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    return F.when(is_kind(value, "STRING"), whole).when(is_kind(value, "ARRAY"), listed).when(is_kind(value, "OBJECT"), of_object).otherwise(rest)


def payload_text(payload: Column, assistant_output: bool = False) -> Column:
    """The text of a message payload. Blocks of output are left out unless asked for."""
    kind = F.try_variant_get(field(payload, "type"), "$", "string")
    message, elements, content = field(payload, "message"), field(payload, "text_elements"), field(payload, "content")
    listed = F.array_join(F.filter(F.transform(items(elements), text_of), lambda t: t.isNotNull()), "\n")
    user = F.when(is_kind(message, "STRING"), F.try_variant_get(message, "$", "string")).otherwise(listed)
    kinds = ("input_text", "text", "output_text") if assistant_output else ("input_text", "text")
    plain = F.when(is_kind(content, "STRING"), F.try_variant_get(content, "$", "string")).otherwise(_joined(content, kinds, "\n", True))
    return F.coalesce(F.when(kind == "user_message", user).when(kind == "message", plain), F.lit(""))


def executable(command: Column) -> Column:
    """The first command's program: the second word after an assignment or a prefix, else the first word's last part."""
    head = F.split(strip(F.coalesce(command, F.lit(""))), r"&&|\|\||;|\||\n", 2)[0]
    words = F.filter(F.split(strip(head), java(r"\s+")), lambda w: w != "")
    first = F.get(words, 0)
    skip = (first.isin("env", "command", "time") | first.contains("=")) & (F.size(words) > 1)
    name = F.regexp_extract(first, "([^/]*)/*$", 1)
    return F.coalesce(F.when(skip, F.get(words, 1)).when(name == ".", F.lit("")).otherwise(name), F.lit(""))


def blamed_executable(command: Column, ignore: frozenset[str]) -> Column:
    """The first program worth blaming among a line's commands; programs that are ignored blame nobody."""
    parts = F.filter(F.transform(F.split(F.coalesce(command, F.lit("")), r"\s*(?:&&|\|\||;|\||\n)\s*"), executable), lambda e: e != "")
    ignored = lambda e: e.isin(*sorted(ignore)) | e.startswith("-") | e.startswith("<")
    found = F.get(F.filter(parts, lambda e: ~ignored(e)), 0)
    return F.when(matches(command, catalog.CODE_HEAD), F.lit("")).otherwise(F.coalesce(found, F.lit("")))


def mcp_server(tool: Column) -> Column:
    part = F.get(F.split(tool, "__"), 1)
    return F.coalesce(F.nullif(part, F.lit("")), tool)


def is_scaffold(text: Column, path: Column, settings: Settings) -> Column:
    """Text that a harness put in and no user typed."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), java(r"^\s+"), "")
    head = F.lower(F.substring(body, 1, catalog.SCAFFOLD_CHARS))
    marked = F.when(F.coalesce(text, F.lit("")) == "", False).otherwise(matches(body, catalog.LEADING_TAG) | _holds(head, settings.scaffold_markers))
    return path.contains("/subagents/") | marked


def is_pasted(text: Column) -> Column:
    from tracemill.functions.patterns import count_of

    return matches(text, catalog.SPEAKER) | (count_of(text, catalog.CLOCK) >= 2)


def is_correction(text: Column, path: Column, settings: Settings) -> Column:
    """A cue near the start of a text that is short enough for it, typed by a user."""
    body = strip(F.coalesce(text, F.lit("")))
    head, size = F.substring(body, 1, catalog.CUE_CHARS), F.length(body)
    cue = ((size <= catalog.STRONG_CHARS) & matches(head, catalog.STRONG_CUE)) | ((size <= catalog.WEAK_CHARS) & matches(head, catalog.WEAK_CUE))
    return (F.coalesce(text, F.lit("")) != "") & ~is_scaffold(text, path, settings) & ~is_pasted(text) & cue


def empty_payload(output: Column) -> Column:
    """What stands for an empty result once a runner's envelope is off; null if there is more."""
    body = F.coalesce(output, F.lit(""))
    for head in (catalog.RUNNER_HEAD, catalog.EXIT_HEAD):
        body = F.regexp_replace(body, java(head), "")
    body = strip(body)
    return F.when(body == "", F.lit("(empty stdout)")).when(matches(body, catalog.EMPTY_SHAPE), body)
