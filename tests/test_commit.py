"""A run is staged whole and put in place whole, wherever it is cut off; the index is looked up by bucket."""

import json

import pytest

from tracemill.plans import commit, session_index
from tracemill.plans.commit import Commit, recover


class Cut(Exception):
    pass


def a_run(root, run_id, n):
    c = Commit(root, run_id)
    for k in range(n):
        c.write_json(f"proposals/{run_id}/{k}.json", {"k": k})
    c.write_text(f"packets/{run_id}.md", "page")
    part = c.path(f"index/part-{run_id}.json")
    part.write_text("{}\n")
    c.path("index/_SUCCESS").write_text("")
    c.remove("index/old.json")
    c.write_json("state.json", {"last": run_id})
    c.write_json(f"runs/{run_id}.json", {})
    c.finish()


def tree(root):
    return {p.relative_to(root).as_posix(): p.read_text() for p in root.rglob("*") if p.is_file()}


def fresh(root):
    (root / "index").mkdir(parents=True)
    (root / "index/old.json").write_text("old")
    (root / "state.json").write_text(json.dumps({"last": "r0"}))
    return tree(root)


def test_cut_off_at_every_step(tmp_path, monkeypatch):
    before, names = fresh(tmp_path / "whole"), []
    with monkeypatch.context() as m:
        m.setattr(commit, "step", names.append)
        a_run(tmp_path / "whole", "r1", 3)
    after = tree(tmp_path / "whole")
    assert set(after) == {"proposals/r1/0.json", "proposals/r1/1.json", "proposals/r1/2.json", "packets/r1.md", "index/part-r1.json", "state.json", "runs/r1.json"}
    placed = [x for x in names if x.startswith("place")]
    assert placed[-2:] == ["place state.json", "place runs/r1.json"]
    for at in range(len(names)):
        root = tmp_path / f"cut{at}"
        fresh(root)
        left = iter(range(len(names)))

        def cut(name):
            if next(left) == at:
                raise Cut

        with monkeypatch.context() as m:
            m.setattr(commit, "step", cut)
            with pytest.raises(Cut):
                a_run(root, "r1", 3)
        if at % 2:  # and again while it is made good
            seen = []

            def again(name):
                seen.append(name)
                if len(seen) == 2:
                    raise Cut

            with monkeypatch.context() as m:
                m.setattr(commit, "step", again)
                try:
                    recover(root)
                except Cut:
                    pass
        done = recover(root)
        binding = at > names.index("manifest")
        assert tree(root) == (after if binding else before) and set(done) <= {"r1"}
        assert recover(root) == [] and not any((root / ".staging").glob("*"))


def rows(spark, keys):
    names = ", ".join(f"{f} string" for f in session_index.FIELDS)
    blank = dict.fromkeys(session_index.FIELDS)
    data = [tuple((blank | {"path": p, "ended_at": e})[f] for f in session_index.FIELDS) + (n,) for n, (p, e) in enumerate(keys)]
    return spark.createDataFrame(data, f"{names}, session_ord long")


def add(spark, root, run_id, keys):
    c = Commit(root, run_id)
    n = session_index.stage_new(spark, rows(spark, keys), root, c)
    c.finish()
    return n


def lines(root):
    return sorted((r["path"], r["ended_at"]) for p in root.glob(f"{session_index.LINES}/part-*") for r in map(json.loads, p.read_text().splitlines()))


def files_read(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaf = plan.collectLeaves().head()
    return int(leaf.metrics().apply("numFiles").value()), int(leaf.metrics().apply("numPartitions").value())


def test_the_index_takes_each_session_once(spark, tmp_path):
    first = [(f"/p/{k}.jsonl", "t") for k in range(300)]
    assert add(spark, tmp_path, "r1", first) == 300 and lines(tmp_path) == sorted(first)
    assert add(spark, tmp_path, "r2", first) == 0
    more = [("/p/7.jsonl", "later"), ("/p/7.jsonl", "later"), ("/p/8.jsonl", "t"), ("/new", None)]
    assert add(spark, tmp_path, "r3", more) == 3  # two of one key in one run both stay
    assert add(spark, tmp_path, "r4", more) == 0
    assert sorted(map(str, lines(tmp_path))) == sorted(map(str, [*first, more[0], more[0], more[3]]))


def test_only_touched_buckets_are_read(spark, tmp_path):
    add(spark, tmp_path, "r1", [(f"/p/{k}.jsonl", "t") for k in range(1000)])
    wanted = session_index.keyed(rows(spark, [("/p/5.jsonl", "t"), ("/p/5.jsonl", "u")]))
    buckets = {r.bucket for r in wanted.collect()}
    known = session_index.on_record(spark, tmp_path, wanted)
    n_files, n_partitions = files_read(known)
    assert n_partitions == len(buckets) and n_files == len(buckets) < session_index.BUCKETS
    assert [(r.path, r.ended_at) for r in known.collect()] == [("/p/5.jsonl", "t")]


def test_many_small_files_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session_index, "BUCKETS", 1)
    monkeypatch.setattr(session_index, "FILES", 3)
    for k in range(5):
        assert add(spark, tmp_path, f"r{k}", [(f"/p/{k}", "t")]) == 1
        assert len(list(tmp_path.glob(f"{session_index.KEYS}/bucket=0/part-*"))) <= 3
    assert add(spark, tmp_path, "again", [(f"/p/{k}", "t") for k in range(5)]) == 0 and len(lines(tmp_path)) == 5


def test_an_index_of_lines_alone_is_taken_over(spark, tmp_path):
    (tmp_path / session_index.LINES).mkdir()
    (tmp_path / session_index.LINES / "part-0.json").write_text(json.dumps({"path": "/a", "ended_at": "t"}) + "\n")
    assert add(spark, tmp_path, "r1", [("/a", "t"), ("/b", "t")]) == 1
    assert add(spark, tmp_path, "r2", [("/a", "t"), ("/b", "t")]) == 0
