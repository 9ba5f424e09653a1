"""The registered queries: their columns and rows, and plain versions of what SQL can't say."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.test_operators import words_of
from tracemill.llm import _common, byte_bpe, chat_format, collocations, interpolation, license_scan, mixing, packing, quality, simhash, simhash_dedup, similar_texts, suffix_dedup
from tracemill.llm.entry import queries

#: Columns that come first, and their types.
COLUMNS = {
    "op1_license_scan": "doc_id bigint, license string, containment double, begin_word bigint, end_word bigint",
    "op2_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_quality_classifier": "doc_id bigint, host string, path string, p_quality double, p_toxic double, host_posterior double, path_posterior double, p_accept double, accept boolean",
    "op4_simhash_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op5_exact_topk": "query_id bigint, rank int, match_id bigint, distance int",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_chat_format": "",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_sessions": "client_id bigint, session_id bigint, start_us bigint, end_us bigint, n_clicks bigint, n_late bigint, value_cents bigint, closed_by string, path_sha256 string",
    "op12_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}
PER_DOCUMENT = ("op2", "op3", "op4", "op7", "op8", "op10", "op12")


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir)
    want = [tuple(c.split(" ")) for c in COLUMNS[name].split(", ")] if COLUMNS[name] else []
    assert got.dtypes[: len(want)] == want
    rows = got.collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    if name.startswith(PER_DOCUMENT):
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name.startswith("op5"):
        known = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
        assert Counter(r.query_id for r in rows) == {q: min(10, len(known)) for q in known if q % 100 == 0}
    if name.startswith("op6"):
        assert {r.doc_id for r in rows} == set(ids) and all(0 <= r.ids_crc32 < 1 << 32 and 0 < r.length <= 4096 for r in rows)
        places = defaultdict(list)
        for r in rows:
            places[r.sequence_id].append((r.offset, r.length))
        for found in places.values():  # gapless, and within the capacity
            assert [a for a, _ in sorted(found)] == [0, *np.cumsum([n for _, n in sorted(found)])[:-1].tolist()] and sum(n for _, n in found) <= 4096
    if name.startswith("op4"):
        assert all(re.fullmatch("[0-9a-f]{32}", r.fingerprint) for r in rows)
        prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
        for r in rows:
            assert (r.n_within is None) == (r.doc_id % 100 != 0)
            if r.doc_id % 100 == 0:
                assert r.n_within == sum((x ^ prints[r.doc_id]).bit_count() <= simhash.RADIUS for x in prints.values())
            assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / simhash.BITS


def plain_fingerprint(text):
    """The votes of words and pairs, one at a time."""
    found = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    terms = [t.encode() for t in found + [f"{a} {b}" for a, b in itertools.pairwise(found)]]
    weights = [min(8, 1 + (len(t) >> 2)) for t in terms]
    out = ""
    for k in range(simhash.BITS // 64):
        hashes = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(t, 42)) for t in terms]
        out += f"{sum(1 << i for i in range(64) if 2 * sum(w for h, w in zip(hashes, weights, strict=True) if h >> i & 1) > sum(weights)):016x}"
    return out


def test_votes_of_fingerprints(docs, rows):
    got = simhash.fingerprint_documents(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("fp")).collect()
    assert sorted((str(r.doc_id), r.fp) for r in got) == sorted((str(r[0]), plain_fingerprint(r[1])) for r in rows)


def plain_scores(texts):
    """Deleted interpolation word by word: texts by id; EM over every token, no bins."""
    end, start = "\0end", "\0start"
    said = {i: [*words_of(t), end] for i, t in texts.items()}
    train = [i for i in said if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(w for i in train for w in said[i]), Counter(p for i in train for p in itertools.pairwise([start, *said[i]]))
    n, v = sum(one.values()), len(one)
    context = one | Counter({start: len(train)})
    kind = lambda c: min(interpolation.CLASSES - 1, 1 + int(math.log2(c))) if c > 0 else 0
    parts = lambda pair, c, w, n: (pair / c if c > 0 else 0.0, w / max(n, 1), 1 / (v + 1))
    tokens = []
    for i in train:
        own, own_two = Counter(said[i]) + Counter([start]), Counter(itertools.pairwise([start, *said[i]]))
        for u, w in itertools.pairwise([start, *said[i]]):
            c = context[u] - own[u]
            tokens.append((kind(c), parts(two[u, w] - own_two[u, w], c, one[w] - own[w], n - len(said[i]))))
    weights = np.full((interpolation.CLASSES, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    classes, estimates = np.array([k for k, _ in tokens]), np.array([p for _, p in tokens])
    for _ in range(interpolation.ROUNDS):
        share = weights[classes] * estimates
        share /= share.sum(axis=1, keepdims=True)
        new = np.stack([np.bincount(classes, share[:, k], interpolation.CLASSES) for k in range(3)], axis=1) + 1e-3
        new[0, 0] = 0
        weights = new / new.sum(axis=1, keepdims=True)
    return {i: sum(math.log10(np.dot(weights[kind(context[u])], parts(two[u, w], context[u], one[w], n))) for u, w in itertools.pairwise([start, *said[i]])) for i in said}


def test_scores_word_by_word(docs, rows):
    got = {r.doc_id: r.score for r in interpolation.score(docs).collect()}
    want = plain_scores({r[0]: r[1] for r in rows})
    assert got.keys() == want.keys()
    for i, score in want.items():  # the bins of a quarter of a power of two move the weights a little
        assert got[i] == pytest.approx(score, rel=0.02), i


def test_best_paths_among_all():
    """Viterbi against every sequence of states."""
    rng = np.random.default_rng(7)
    states = chat_format.STATES
    for n in range(1, 6):
        for _ in range(5):
            model = chat_format.Model(rng.random(states) * 9, rng.random((states, states)) * 9, [])
            scores = rng.normal(size=(n, states))
            best, back = chat_format.forward(model, scores, model.start)
            path = chat_format.trace(back, int(best.argmax()))
            value = lambda p: model.start[p[0]] + scores[0, p[0]] + sum(model.move[a, b] + scores[k + 1, b] for k, (a, b) in enumerate(itertools.pairwise(p)))  # noqa: E731, B023
            top = max(map(value, itertools.product(range(states), repeat=n)))
            assert value(path.tolist()) == pytest.approx(top) and best.max() == pytest.approx(top)


def test_licenses_in_every_window():
    """Bands against all windows: one template at a time, texts that hold all, most, half or none of it."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for size in (6, 30, 150):
        template = prose(size)
        texts = []
        for _ in range(60):
            held = [w if rng.random() > rng.choice((0, 0, 0.01, 0.03, 0.3)) else "changed" for w in template[: rng.choice((size, size, size * 9 // 10, size // 2))]]
            texts.append(" ".join(prose(rng.randrange(300)) + held + prose(rng.randrange(50))))
        index = license_scan.Index({"it": " ".join(template)})
        data = [t.encode() for t in texts]
        h, count = license_scan.shingles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        got = {r: share for r, _, share, *_ in license_scan.scan_shingles(index, h, count)}
        want, (distinct, n) = {}, index.sets[0]
        width, at = 1 << (n - 1).bit_length(), np.cumsum(count) - count
        for r in range(len(texts)):
            own = h[at[r] : at[r] + count[r]]
            share = max((len(np.intersect1d(own[k : k + 2 * width], distinct)) / len(distinct) for k in range(0, len(own), width)), default=0)
            if share >= license_scan.CONTAINED:
                want[r] = share
        assert got.keys() == want.keys() and all(got[r] <= want[r] for r in got) and want


def test_site_posteriors_by_hand(spark, sf_dir, docs):
    """Hosts, paths, their strengths and every document's odds, recomputed from its own probability."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = _common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source").withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://a.example/"), "lang", F.lit("/x"))).otherwise(F.col("source")))
    own = {r.doc_id: r for r in quality.evidence(given, quality.train(given, labels)).collect()}
    got = {r.doc_id: r for r in quality.classify(given, labels).collect()}
    p = {i: 1 / (1 + math.exp(-r.own)) for i, r in own.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, r in own.items():
        hosts[r.host].append(p[i])
        paths[r.host, r.path].append(p[i])
    mean = sum(p.values()) / len(p)

    def strength(groups, centre):
        many = [(g, x) for g, x in groups.items() if len(x) > 1]
        between = sum(len(x) * (sum(x) / len(x) - centre(g)) ** 2 for g, x in many)
        n, squares = sum(len(x) for _, x in many), sum(len(x) ** 2 for _, x in many)
        spread = sum(centre(g) * (1 - centre(g)) for g, _ in many) / len(many)
        variance = (between - len(many) * spread) / (n - squares / n)
        return min(quality.STRENGTH[1], max(quality.STRENGTH[0], spread / variance - 1)) if variance > 0 else quality.STRENGTH[1]

    host_k = strength(hosts, lambda g: mean)
    path_k = strength(paths, lambda g: (sum(hosts[g[0]]) + host_k * mean) / (len(hosts[g[0]]) + host_k))
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for i, r in own.items():
        host = (sum(hosts[r.host]) - p[i] + host_k * mean) / (len(hosts[r.host]) - 1 + host_k)
        path = (sum(paths[r.host, r.path]) - p[i] + path_k * host) / (len(paths[r.host, r.path]) - 1 + path_k)
        odds = r.own + logit(path) - logit(mean)
        assert got[i].host_posterior == pytest.approx(host) and got[i].path_posterior == pytest.approx(path)
        assert got[i].p_accept == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9) and got[i].accept == (got[i].p_accept >= quality.THRESHOLD - 1e-12)


def test_long_texts_whole(spark):
    """Three million bytes in one text: read to its end by every other operator over documents."""
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    long_one = " ".join(rng.choice(vocabulary) for _ in range(430_000))
    texts = {1: long_one, 2: long_one + " theend", 3: None, 4: "", 5: "short and plain"}
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    judged = {r.doc_id for r in quality.classify(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert judged == set(texts)
    prints = {r.doc_id: r for r in simhash.fingerprint_documents(df).collect()}
    assert {i: r.n_chars for i, r in prints.items()} == {i: len(t or "") for i, t in texts.items()} and prints[3].fp == prints[4].fp
    near = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    stay = {r.doc_id for r in similar_texts.deduplicate(df).collect()}
    assert stay == {1, 3, 5}
    mixed, _ = mixing.mix_sources(df, F.array("source"))
    assert {r.doc_id: r.size for r in mixed.collect()} == {1: 430_000, 2: 430_001, 3: 0, 4: 0, 5: 3}
    counted = {r.phrase: r.a for r in collocations.frequent_phrases(df, _common.Tables(spark, "long"))[0].where("words = 1").collect()}
    words = Counter(words_of(long_one))
    assert counted == {w: 2 * n for w, n in words.items() if 2 * n >= collocations.LEAST}
    some = df.where("doc_id IN (2, 3, 5)")
    pieces = packing.pack_documents(some, P.path("word_bpe_49k.json")).collect()
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in (2, 3, 5)} == {i: len(whole.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in (2, 3, 5)}
    digests = {r.doc_id: r for r in byte_bpe.digest_documents(some, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert all(digests[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i in (2, 3, 5))


def test_a_text_longer_than_a_chunk(spark):
    """Seventeen million bytes in one text, and a copy of a part of it."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    long_one = " ".join(rng.choice(vocabulary) for _ in range(2_500_000))
    df = spark.createDataFrame([(1, long_one), (2, long_one[5_000_000:5_002_000]), (3, None), (4, "")], "doc_id long, text string")
    spans = suffix_dedup.remove_repeats(df, lambda i, t, s: (i, len(t), sum(b - a for a, b in s)), "doc_id long, n long, gone long").collect()
    assert {r.doc_id: (r.n, r.gone) for r in spans} == {1: (len(long_one), 2000), 2: (2000, 2000), 3: (0, 0), 4: (0, 0)}
    assert {r.doc_id for r in license_scan.scan(df).collect()} == set()
    scored = {r.doc_id: r for r in interpolation.score(df).collect()}
    assert scored[1].n_tokens == 2_500_001 and scored[3].n_tokens == scored[4].n_tokens == 1


def test_a_passage_goes_from_400_bytes_on(spark, tmp_path):
    """Of passages of over 50 words that two documents share, one of 399 bytes stays, one of 400 goes; n_bytes is of the whole text."""
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = [prose(60)[:399], prose(60)[:400], "é" * 10 + prose(60)[:379], "é" * 10 + prose(60)[:380]]
    assert all(len(s.split()) > 50 for s in shared) and [len(s.encode()) for s in shared] == [399, 400, 399, 400]
    texts = [f"{prose(20)} {'<(['[k]}{s}{'>)]'[k]} {prose(20)}" for s in shared for k in range(2)]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op8_suffix_dedup"](spark, str(tmp_path)).collect()
    left = [t if n // 2 % 2 == 0 else t.replace(shared[n // 2], "") for n, t in enumerate(texts)]
    want = {(n, len(t.encode()), 400 * (n // 2 % 2), n // 2 % 2, hashlib.sha256(s.encode()).hexdigest()) for n, (t, s) in enumerate(zip(texts, left, strict=True))}
    assert {tuple(r) for r in got} == want
