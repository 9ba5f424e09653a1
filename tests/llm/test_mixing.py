"""Mixing: the flow against enumeration, targets and documents against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import _common, mixing

DOCS = "doc_id long, text string, source string, also array<string>, size string, taken long, draw int"


def words_of(n):
    return " ".join(["w"] * n)


def plain_targets(sizes):
    """Weights along the order, what is over reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        target = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: 2.0 * sizes[s] for s in full}
        full |= set(over)
        left -= sum(2 * sizes[s] for s in over)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = rng.choice([0, 1, 5, 20, 60, 400])
        source = "hot" if k % 3 == 0 else rng.choice(["a", "b", "é", "Z", "😀", "", None])
        text = None if k % 50 == 0 else "\t" + words_of(size) + "\x0b\n"
        rows.append((k if k % 37 else None, text, source, None, "x", 7, 3))
    return rows + [rows[5]] * 3 + [(9000, "x\x85y\xa0z " * 5000, "big", None, None, None, None)]


def size_of(text):
    return len([w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w])


def test_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    runs = []
    for parts in (1, 5):
        mixed, targets = mixing.mix_sources(docs.repartition(parts), F.array("source"))
        runs.append((sorted(map(str, mixed.collect())), {r.source: (r.words, r.target) for r in targets.collect()}))
    assert runs[0] == runs[1]
    found = mixed.collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    want = plain_targets(sizes)
    assert {s: v[0] for s, v in runs[0][1].items()} == sizes
    assert {s: v[1] for s, v in runs[0][1].items()} == {s: pytest.approx(t) for s, t in want.items()}
    taken = {}
    for r in found:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        assert r.taken == sum(x.words for x in r.by_source) and {x.source for x in r.by_source} <= set(r.sources)
        taken[r.sources[0]] = taken.get(r.sources[0], 0) + r.taken
    for source, target in want.items():
        least = min((size_of(t) for _, t, s, *_ in rows if s == source and size_of(t)), default=0)
        assert abs(taken[source] - target) <= max(1, least / 2, 0.005 * target)


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, "a", None, None, None, None), (2, "", None, None, None, None, None)]):
        mixed, targets = mixing.mix_sources(spark.createDataFrame(rows, DOCS), F.array("source"))
        assert [(r.size, r.taken) for r in mixed.collect()] == [(0, 0)] * len(rows)
        assert [r.target for r in targets.collect()] == [0.0] * len({r[2] for r in rows})


def test_more_sources_than_fit_a_weight(spark):
    """Every source full but one: the level rises step by step."""
    rows = [(k, words_of(3 ** (k % 7)), f"s{k % 7}", None, None, None, None) for k in range(70)]
    _, targets = mixing.mix_sources(spark.createDataFrame(rows, DOCS), F.array("source"))
    sizes = {f"s{k}": 10 * 3**k for k in range(7)}
    assert {r.source: r.target for r in targets.collect()} == {s: pytest.approx(t) for s, t in plain_targets(sizes).items()}


def least_cost(capacity, wanted, links, most):
    """Most words, then least cost, by trying every split."""
    best = None
    for split in itertools.product(*(range(min(capacity[p] * most, wanted[s]) + 1) for p, s in links)):
        own, got = [0] * len(capacity), [0] * len(wanted)
        for (p, s), x in zip(links, split, strict=True):
            own[p] += x
            got[s] += x
        if any(o > c * most for o, c in zip(own, capacity, strict=True)) or any(g > w for g, w in zip(got, wanted, strict=True)):
            continue
        cost = sum(sum(k * min(c, max(0, o - k * c)) for k in range(most)) for o, c in zip(own, capacity, strict=True))
        best = min(best or (1, 0), (-sum(split), cost))
    return best


def test_flow_against_enumeration():
    rng = random.Random(2)
    for _ in range(60):
        capacity, wanted = [rng.randrange(1, 4) for _ in range(3)], [rng.randrange(0, 6) for _ in range(2)]
        links = [(p, s) for p in range(3) for s in range(2) if rng.random() < 0.7]
        flow = mixing.least_cost_flow(capacity, wanted, links, 2)
        own = [sum(x for (p, _), x in flow.items() if p == k) for k in range(3)]
        cost = sum(max(0, o - c) for o, c in zip(own, capacity, strict=True))
        assert set(flow) <= set(links) and (-sum(flow.values()), cost) == least_cost(capacity, wanted, links, 2)


def test_overlapping_sources(spark):
    """Documents of two sources go where the quota is short; none is repeated while another is unused."""
    rows = [(k, words_of(10), None, ["a"] if k < 20 else ["b", "a", "b"] if k < 60 else ["b"] if k < 70 else [None], None, None, None) for k in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    tables = _common.Tables(spark, "test")
    sized = mixing.sized(docs, F.col("also"))
    targets = spark.createDataFrame([("a", 0, 400.0), ("b", 1, 300.0), (None, 2, 150.0)], "source string, nth long, target double")
    found = mixing.mix(sized, targets, tables).collect()
    got = {}
    for r in found:
        for x in r.by_source:
            got[x.source] = got.get(x.source, 0) + x.words
            assert x.source in r.sources
    assert got == {"a": 400, "b": 300, None: 150}
    assert all(r.taken == 10 for r in found if r.sources != [None]) and sum(r.taken for r in found if r.sources == [None]) == 150


def test_a_document_without_sources(spark):
    rows = [(1, "a b", None, [], None, None, None), (2, "a b c", None, ["s"], None, None, None), (3, "q", None, None, None, None, None)]
    mixed, _ = mixing.mix_sources(spark.createDataFrame(rows, DOCS), F.col("also"))
    assert sorted((r.doc_id, r.size, r.taken) for r in mixed.collect()) == [(1, 2, 0), (2, 3, 3), (3, 1, 0)]
