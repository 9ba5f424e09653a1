"""Discovery, choice and numbering of files, and windows over a long file, all as tables."""

import datetime as dt
import inspect
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from transcripts import claude, in_claude, in_codex, result, use

from tracemill.config import Settings
from tracemill.operators import evidence, normalize, ordinals
from tracemill.sources import shared, transcripts


def chosen(found, *args):
    return [(Path(r.path).stem, r.source) for r in transcripts.choose(found, *args).files.orderBy("session_ord").collect()]


def at(seconds):
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


def test_choice(spark, tmp_path):
    for n in range(4):
        in_claude(tmp_path / "one", f"{n}", [{}], 100 - n // 2)
    in_codex(tmp_path / "one", "other", [{}], 100)
    in_claude(tmp_path / "two", "0", [{}], 99)
    in_claude(tmp_path / "two", "empty", [], 99)
    (tmp_path / "again").mkdir()
    (tmp_path / "again/.claude").symlink_to(tmp_path / "one/.claude")
    found = transcripts.discover(spark, [tmp_path / "one", tmp_path / "again", tmp_path / "two", tmp_path / "none"])
    order = [("2", "claude"), ("3", "claude"), ("0", "claude"), ("0", "claude"), ("1", "claude"), ("other", "codex")]
    assert chosen(found) == order
    assert chosen(found, at(100)) == order[3:] and chosen(found, at(100), 2) == order[4:] and chosen(found, None, 5) == order[1:]
    assert chosen(found, at(101)) == [] and chosen(transcripts.discover(spark, [tmp_path / "one"], "codex")) == order[5:]
    assert chosen(transcripts.discover(spark, [tmp_path / "none"])) == []
    with_scheme = transcripts.discover(spark, [(tmp_path / "one").as_uri()])
    assert sorted(chosen(with_scheme)) == sorted(order[:3] + order[4:])
    old = transcripts.choose(found, at(101))
    assert transcripts.read_lines(spark, old).count() == 0


def test_only_chosen_files_are_opened(spark, tmp_path):
    for n in range(6):
        in_claude(tmp_path, f"{n}", ["{}"] * (n + 1), 100 + n)
    picked = transcripts.choose(transcripts.discover(spark, [tmp_path]), None, 2)
    lines = transcripts.read_lines(spark, picked)
    assert {Path(r.path).stem: r.n for r in lines.groupBy("path").agg(F.count("*").alias("n")).collect()} == {"4": 5, "5": 6}
    assert ".collect(" not in inspect.getsource(transcripts)


def test_settings_are_given_back(spark):
    before = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.own.setting", None)
    with pytest.raises(KeyError), shared.settings_of(spark, spark__sql__session__timeZone="Asia/Tokyo", spark__own__setting="1"):
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo" and spark.conf.get("spark.own.setting") == "1"
        raise KeyError
    assert before == (spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.own.setting", None))


def test_odd_names(spark, tmp_path):
    home = tmp_path / "a b+c%20é"
    in_claude(home, "x y+%41", ["{}", "{}"], 100)
    picked = transcripts.choose(transcripts.discover(spark, [home]))
    assert [r.path for r in picked.files.collect()] == [str(home / ".claude/projects/p/x y+%41.jsonl")]
    assert [(r.path, r.line) for r in transcripts.read_lines(spark, picked).orderBy("line").collect()] == [(str(home / ".claude/projects/p/x y+%41.jsonl"), n) for n in (1, 2)]


def test_ten_thousand_files(spark, tmp_path):
    """Files come with ties, and their numbers are those of one sort."""
    rng = random.Random(1)
    base, want = tmp_path / ".claude/projects", []
    for d in range(100):
        (base / f"p{d}").mkdir(parents=True)
        for n in range(100):
            path = base / f"p{d}/{n}.jsonl"
            path.write_text("{}\n")
            mtime = 1_900_000_000 + rng.randrange(300)
            os.utime(path, (mtime, mtime))
            want.append((mtime, str(path)))
    files = transcripts.choose(transcripts.discover(spark, [tmp_path]), None, 9_000).files
    got = sorted((r.session_ord, r.path) for r in files.select("session_ord", "path").toLocalIterator())
    assert [p for _, p in got] == [p for _, p in sorted(want)][1_000:] and [n for n, _ in got] == list(range(1_000, 10_000))


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("hot")).repartition(5)
        got = ordinals.numbered(rows, ["hot", "x"]).collect()
        assert [r.nth for r in sorted(got, key=lambda r: (r.hot, r.x))] == list(range(1000))
        assert ordinals.numbered(rows.where("false"), ["x"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def long_file(n):
    rng, lines = random.Random(4), []
    for k in range(n):
        kind, sid = rng.randrange(9), f"s{k * 5 // n}"
        said = {0: lambda: claude("user", rng.choice(["no, that's wrong. Use the other one", "go on", f"actually use {k} instead", "<system-reminder> never"]), sid=sid)}
        said[1] = lambda: claude("assistant", [{"type": "text", "text": rng.choice(["It returned no results.", "Next step."])}], sid=None)
        said[2] = said[3] = lambda: claude("assistant", [use(f"c{rng.randrange(40)}", rng.choice(["alpha-pp-cli list", "git status", "beta-pp-cli get"]))], sid=None, cwd=f"/w{k}")
        said[4] = said[5] = lambda: claude("user", [result(f"c{rng.randrange(40)}", rng.choice(["[]", "Exit code 1", "fine", ""]))], sid=None)
        said[6], said[7], said[8] = lambda: "{broken", lambda: "", lambda: claude("user", [result("", "Exit code 1")])
        lines.append(said[kind]())
    return lines


def test_a_long_file_in_stretches(spark, tmp_path):
    """Windows run stretch by stretch; what is found is what one window over the file finds."""
    in_claude(tmp_path, "long", long_file(3000), 1_900_000_000)
    in_claude(tmp_path, "short", long_file(40), 1_900_000_001)
    records = transcripts.records(transcripts.read_lines(spark, transcripts.choose(transcripts.discover(spark, [tmp_path]))))
    rows = normalize.normalized(records).persist()
    whole, cut = ([tuple(map(str, r)) for r in evidence.evidence(normalize.with_context(rows, Settings(), size), Settings()).collect()] for size in (1 << 20, 100))
    assert len(whole) > 500 and sorted(whole) == sorted(cut)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else so few rows are one partition
    try:
        placed = normalize.with_context(rows, Settings(), 100).select(F.spark_partition_id().alias("p"), "path", "session_id", "next_step")
        spread = placed.groupBy("path").agg(F.count_distinct("p").alias("n"), F.max("session_id"), F.count("next_step")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n for r in spread) > 1
