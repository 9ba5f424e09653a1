"""The pipeline end to end, against plain versions of its stages."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.test_operators import plain_components, plain_removal, shingle_set
from tracemill.llm import simhash_dedup, similar_texts

ODD = "_id string, _node string, _own string, gone_id string, gone_node string, own_id string, node string, row string, spans string, cluster string, accept string, rejected_id string, nth string"


def odd_columns(df):
    """df with columns that are named as those that operators make."""
    return df.withColumns({c.split()[0]: F.lit("clash") for c in ODD.split(", ")})


@pytest.mark.parametrize("labelled", [False, True])
def test_stages(spark, docs, rows, tmp_path, labelled):
    """All stages on awkward texts; with labels the first one takes documents away before the others see them."""
    odd_columns(docs.select(*corpus_pipeline.COLUMNS)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(r[0] % 2), 0) for r in rows if r[0] is not None] if labelled else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    accepted = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, given, str(tmp_path)).collect()}
    assert labelled == (len(accepted) < len(rows))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of similar texts the least id stays
    texts = {r[0]: r[1] or "" for r in rows if r[0] in accepted}
    known = [i for i in texts if i is not None]
    sets = {i: shingle_set(texts[i]) for i in known}
    stay = set(plain_components(known, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])).values()) | ({None} & accepted)
    assert {r.doc_id for r in out} == stay
    assert sum(r.piece == 0 for r in out) == len(stay)


def test_passages_of_51_words_go(spark, sf_dir, tmp_path):
    """Passages of 51 words that two documents share go, whatever stands around them; other documents stay as they are."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice((2, 3, 4, 5, 6, 7, 8)))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [prose(51) for _ in range(20)]
    texts = [prose(rng.randrange(60, 200)) + " " + shared[n // 2] + " " + prose(rng.randrange(60, 200)) for n in range(40)] + [prose(300) for _ in range(20)]
    df = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, df, sf_dir).collect()}
    want = plain_removal([t.encode() for t in texts], corpus_pipeline.PASSAGE)
    for n, text in enumerate(texts):
        left = text.encode()
        for a, b in reversed(want[n]):
            left = left[:a] + left[b:]
        assert got[n].text == left.decode() and got[n].n_chars == len(got[n].text)
        assert shared[n // 2] not in got[n].text if n < 40 else got[n].text == text


def test_stages_of_nothing(spark, no_docs, sf_dir):
    empty = no_docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_toxic_documents_go(spark, sf_dir):
    """With some thousand labels, as at a tenth of the unit size, nearly all toxic documents go and the clean ones stay."""
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    if not os.path.isdir(sf_dir):
        pytest.skip("no table with enough labels here")
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, given, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    count = lambda df: {(r.quality, r.toxic): r["count"] for r in df.groupBy("quality", "toxic").count().collect()}
    n, of = count(labels.join(kept.select("doc_id"), "doc_id", "left_semi")), count(labels)
    assert n[1, 0] >= 0.97 * of[1, 0] and n.get((0, 0), 0) <= 0.03 * of[0, 0] + 2
    assert n.get((1, 1), 0) <= 0.03 * of.get((1, 1), 0) + 1 and n.get((0, 1), 0) <= 0.03 * of.get((0, 1), 0) + 1


def test_near_copies_with_clashing_columns(spark):
    """All columns are passed on; two texts that share a hash are two texts."""
    df = odd_columns(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here"), (None, None)], "doc_id long, text string"))
    out = similar_texts.deduplicate(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 3, None}


def test_shared_hashes(spark, monkeypatch):
    monkeypatch.setattr(similar_texts.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if len(c) == 1 else F.hash(*c).cast("long"))
    df = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "d e f"), (4, "longer text")], "doc_id long, text string")
    node = similar_texts._node_of(df, None)
    assert df.select("doc_id", node.alias("n")).distinct().groupBy("n").count().count() >= 2


def test_simhash_components_propose(spark, sf_dir, monkeypatch):
    """Near copies within three bits are found where no band is shared; texts of equal fingerprints that differ stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    rows = []
    while len(rows) < 20:
        text = [word() for _ in range(400)]
        copy = [*text]
        copy[200] = word()
        a, b = (simhash_dedup.majority(simhash_dedup.shingle_hashes(" ".join(x))) for x in (text, copy))
        if (a ^ b).bit_count() <= 3:
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    line = "zero " * 200
    rows += [(20 + k, line + " ".join(word() for _ in range(60))) for k in range(4)]
    assert len({simhash_dedup.majority(simhash_dedup.shingle_hashes(t)) for _, t in rows[20:]}) == 1
    banded = similar_texts.bands_of
    monkeypatch.setattr(similar_texts, "bands_of", lambda docs, bands: banded(docs, bands).withColumn("bands", F.array("node")))
    df = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, sf_dir).collect()}
    assert kept == {*range(0, 20, 2), *range(20, 24)}
