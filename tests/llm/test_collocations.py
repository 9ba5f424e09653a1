"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import collocations as m

DOCS = "doc_id long, text string, lang string, n long, rank string, phrase string"


def plain(rows, least=30, per_cent=80, first=2000):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if a >= least}
        inside = {}
        for q, a in often.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i : i + k]] = max(inside.get(q[i : i + k], 0), a)
        kept = []
        for p, a in often.items():
            if len(p) < 2 or 100 * inside.get(p, -1) >= per_cent * a:
                continue
            score, k = min((2_000_000 * a // (often[p[:k]] + often[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def got(df):
    found = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(found) == len(set(found))
    return set(found)


def corpus(seed=7, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé😀") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    fixed = ["new york city", "In Spite of", "a a a a a", "x\xa0y z\x85", "one two three four five"]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.5 else rng.choice(vocabulary))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", "!?"]))
        rows.append((k, "".join(parts), ["en", "en", "de", None, "und", ""][k % 6], 3, "q", "z"))
    return rows + [(None, None, "en", 1, "q", "z"), (5, "", None, 1, "q", "z"), (6, "the same line again and again. " * 3000, "fr", 1, "q", "z"), (7, "y" * 100_000 + " z", "fr", 1, "q", "z"), rows[4], rows[4]]


@pytest.mark.parametrize("block,parts", [(m.BLOCK, 1), (200, 4)])
def test_collocations(spark, monkeypatch, block, parts):
    monkeypatch.setattr(m, "BLOCK", block)
    rows = corpus()
    want = plain(rows)
    assert len(want) > 50
    assert got(m.mine(spark.createDataFrame(rows, DOCS).repartition(parts))) == want


def test_few_counters_lose_nothing(spark, monkeypatch):
    """Where all counters are overfull, everything goes to the exact count, and the result is the same."""
    rows = corpus(8)
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(m, "ROWS", 1)
    seen = []
    partial = m.partial_sketches
    monkeypatch.setattr(m, "partial_sketches", lambda blocks, bits, parts: seen.append(bits) or partial(blocks, 10, 1))
    merged, survivors = m.merged, m.survivors
    monkeypatch.setattr(m, "merged", lambda p, width, least: merged(p, 1 << 10, least))
    monkeypatch.setattr(m, "survivors", lambda b, r, bits, parts: survivors(b, r, 10, 1))
    assert got(m.mine(docs, first=40)) == plain(rows, first=40)
    assert seen


def test_ranks_are_cut_and_ties_in_byte_order(spark, monkeypatch):
    monkeypatch.setattr(m, "DEALT", (8, 2))
    rows = [(k, ". ".join(f"{a}{b} {b}{a}" for a in "aBé😀z" for b in "aBé😀z"), "en", 1, "q", "z") for k in range(40)]
    assert got(m.mine(spark.createDataFrame(rows, DOCS), first=7)) == plain(rows, first=7)


def test_large_counts_stay_exact(spark):
    big = (1 << 62) + 1
    frequent = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 2), ("en", "b", 1, big + 1), ("en", "a b c", 3, 4), ("en", "b c", 2, 5), ("en", "c", 1, 6)], "lang string, phrase string, words int, a long")
    found = {r.phrase: (r.l, r.r, r.score) for r in m.scored(frequent).collect()}
    assert found["a b"] == (big + 2, big + 1, 2_000_000 * big // (2 * big + 3))
    assert {r.phrase for r in m.without_subsumed(m.scored(frequent), frequent).collect()} == {"a b", "a b c"}


def test_no_documents(spark):
    assert got(m.mine(spark.createDataFrame([], DOCS))) == set()
    assert got(m.mine(spark.createDataFrame([(1, None, "en", 1, "q", "z"), (2, " \t.", None, 1, "q", "z")], DOCS))) == set()


def test_a_sketch_never_falls_below():
    rng = np.random.default_rng(3)
    text = pa.array([" ".join(rng.choice(list("abcdefgh"), 400))])
    data = np.frombuffer(text[0].as_py().encode(), np.uint8)
    found = m.Words(data, np.array([0, len(data)]))
    assert found.text.to_pylist() == text[0].as_py().split(" ") and found.first.sum() == 1


@pytest.mark.parametrize("group", [1, 3, 100])
def test_blocks_of_a_group_are_added_up_first(spark, monkeypatch, group):
    """The same result whatever the group; a group names each counter and each phrase once, however many blocks it has."""
    monkeypatch.setattr(m, "BLOCK", 200)
    monkeypatch.setattr(m, "GROUP", group)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    rows, got_partial, got_found = corpus(), [], []
    partial, survivors = m.partial_sketches, m.survivors

    def sketch(*given):
        out = partial(*given)
        got_partial.extend(out.collect())
        return out

    def survive(*given):
        out = survivors(*given)
        got_found.append(out.groupBy("lang", "phrase", "words").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(m, "partial_sketches", sketch)
    monkeypatch.setattr(m, "survivors", survive)
    try:
        assert got(m.mine(spark.createDataFrame(rows, DOCS).repartition(1))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {r.part_of for r in got_partial}
    assert len(got_partial) == len({(r.part, r.part_of) for r in got_partial})
    assert (len(groups) == 1 and got_found == [1]) if group == 100 else (len(groups) > 3 and got_found[0] > 1)


@pytest.mark.parametrize("bound", [m.RANGE, 50])
def test_groups_hand_on_lists(spark, monkeypatch, bound):
    """What a group hands on is a list for each language, length and range, however many phrases it keeps; each phrase is in
    one list of a group, and lists that are added up some at a time give the same result."""
    monkeypatch.setattr(m, "BLOCK", 200)
    monkeypatch.setattr(m, "GROUP", 2)
    monkeypatch.setattr(m, "RANGE", bound)
    rows, seen = corpus(9), []
    survivors = m.survivors

    def survive(blocks, reached, bits, parts):
        out = survivors(blocks, reached, bits, parts)
        seen.append((blocks.select("part_of").distinct().count(), max(1, parts // m.RANGES), out.collect()))
        return out

    monkeypatch.setattr(m, "survivors", survive)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert got(m.mine(spark.createDataFrame(rows, DOCS).repartition(1))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups, ranges, lists = seen[0]
    phrases = [(r.lang, r.words, len(m.unpack(r.lengths))) for r in lists]
    cells = {(lang, words) for lang, words, _ in phrases}
    assert groups > 3 and (ranges > 1) == (bound == 50)
    assert len(lists) <= groups * ranges * len(cells) and sum(n for _, _, n in phrases) > len(lists)
    for r in lists:
        text = m.zstandard.ZstdDecompressor().decompress(r.texts)
        at = np.r_[0, np.cumsum(m.unpack(r.lengths).astype(int))].tolist()
        spelled = [text[i:j].decode() for i, j in zip(at, at[1:], strict=False)]
        assert at[-1] == len(text) and len(spelled) == len(set(spelled)) == len(m.unpack(r.n))
        assert {x.count(" ") + 1 for x in spelled} == {r.words}


def test_a_sketch_is_as_wide_as_the_words_are_many():
    assert [m.width_of(n) for n in (0, 1, 1 << 16, 1 << 27, (1 << 27) + (1 << 20), 3 << 26, (1 << 28) - 1)] == [16, 16, 16, 27, 27, 28, 28]


def test_nothing_is_frequent(spark):
    """A group of which the sketch lets nothing through, alone and beside one that keeps some."""
    few = [(1, "a b c. d", "en", 1, "q", "z")]
    assert got(m.mine(spark.createDataFrame(few, DOCS))) == set()
    rows = few + [(k, "x y z", "de", 1, "q", "z") for k in range(40)]
    found = got(m.mine(spark.createDataFrame(rows[:1], DOCS).coalesce(1).union(spark.createDataFrame(rows[1:], DOCS).coalesce(1))))
    assert found == plain(rows) and found
