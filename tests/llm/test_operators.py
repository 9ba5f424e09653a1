"""Each operator against a plain version of its contract, on awkward texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import _bwt, _common, byte_bpe, chat_format, components, interpolation, license_scan, packing, quality, similar_texts, simhash, simhash_dedup, suffix_dedup, topk_hamming

BYTE_BPE, WORD_BPE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# --- byte-level BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(BYTE_BPE, P.PATTERN)


@pytest.fixture(scope="module")
def plain_bpe(bpe):
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_byte_bpe_digests(docs, rows, no_docs, plain_bpe):
    got = by_id(byte_bpe.digest_documents(docs, BYTE_BPE, P.PATTERN))
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids = plain_bpe.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == want
    assert byte_bpe.digest_documents(no_docs, BYTE_BPE, P.PATTERN).count() == 0


def test_byte_bpe_round_trip_and_offsets(docs, rows, bpe):
    encoded = byte_bpe.encode_documents(docs, BYTE_BPE, P.PATTERN)
    texts = dict((r[0], r[1] or "") for r in rows)
    assert {r.doc_id: r.text for r in byte_bpe.decode_documents(encoded, BYTE_BPE, P.PATTERN).collect()} == texts
    for r in encoded.collect():
        assert all(0 <= a < b <= len(texts[r.doc_id]) for a, b in zip(r.starts, r.ends, strict=True))
        assert bpe.decode_bytes(r.ids).decode() == texts[r.doc_id]


def test_byte_bpe_ranks_and_overlapping_merges(bpe, plain_bpe):
    """Every token is what its own bytes merge into; strings of overlapping merges go by rank, however long."""
    library, table = bpe.model.model, byte_bpe.byte_table()
    assert all(len(library.tokenize("".join(table[b] for b in t))) == 1 for t in bpe.ranks)
    rng, known = random.Random(11), sorted(t.decode("utf-8", "ignore") for t in bpe.doubtful)
    for _ in range(3000):
        text = "".join(rng.choice([rng.choice(known), rng.choice(" an-=o!"), rng.choice(known)[:2]]) for _ in range(rng.randrange(1, 7)))
        assert bpe.encode(text)[0] == bpe._settle(text) == plain_bpe.encode_ordinary(text), text
    for text in ("-" * 50_001, "an" * 20_001 + " x", "a" * 30_000 + " " + "-" * 30):
        assert bpe.encode(text)[0] == plain_bpe.encode_ordinary(text)


def test_byte_bpe_competing_pairs():
    """Two merges that make one token from different pairs and overlap: the leftmost wins."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"aba": 258, b"ab": 259, b"ba": 260}
    assert b"ababa" not in byte_bpe.overlaps({b"ab": 1}) and b"ababa" in byte_bpe.overlaps(ranks | {b"a": 97})


def test_byte_bpe_noise_and_split_characters(bpe, plain_bpe):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab  \n\t'séß日😀1,.\x1c\x85 ") for _ in range(rng.randrange(40)))
        assert bpe.encode(text)[0] == plain_bpe.encode_ordinary(text) and "".join(bpe.pieces(text)) == text
        ids = plain_bpe.encode_ordinary(text)
        assert "".join(bpe.decode_stream(ids)) == text
    assert list(bpe.decode_stream(plain_bpe.encode_ordinary("😀")))[-1:] == ["😀"]


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing(docs, rows, no_docs):
    ours = Tokenizer.from_file(WORD_BPE)
    ours.encode_special_tokens = True
    got = packing.pack_documents(docs, WORD_BPE, capacity=64, open_bins=3).collect()
    for doc_id, text, *_ in rows:
        ids = np.array([*ours.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc_id) == want
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(no_docs, WORD_BPE).count() == 0


def test_best_fit_keeps_its_bins():
    rng, fit, held = random.Random(2), packing.BestFit(100, 4), Counter()
    for _ in range(3000):
        n = rng.randrange(1, 101)
        best = min((f for f in range(n, 101) if fit.open_at[f]), default=None)
        where, at = fit.put(n)
        assert at == held[where] and (best is None or at == 100 - best)
        held[where] += n
        assert held[where] <= 100 and fit.count <= 4 and fit.bits == sum(1 << f for f in range(101) if fit.open_at[f])
    with pytest.raises(ValueError):
        fit.put(101)


# --- language model -------------------------------------------------------------------------------------------------


def test_scores(docs, rows, no_docs):
    got = by_id(interpolation.score(docs))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {r[0]: [*words_of(r[1]), None] for r in rows}
    counts = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert interpolation.score(no_docs).count() == 0


def test_the_model_is_a_distribution_and_learns():
    weights = interpolation.learn_weights(np.array([(3 * interpolation.BINS + 90) * interpolation.BINS + 70, (3 * interpolation.BINS + 0) * interpolation.BINS + 70]), np.array([90.0, 10.0]))
    assert np.allclose(weights.sum(axis=1), 1) and weights[3, 0] > 0.8 and weights[0, 0] == 0
    data = interpolation.unpack(interpolation.pack(np.arange(1000, dtype=np.uint64) ** 5))
    assert (data == np.arange(1000, dtype=np.uint64) ** 5).all()


@pytest.mark.parametrize("v", [20_000, 1 << 26])
def test_cells_agree_with_em_without_bins(v):
    """However large the vocabulary, estimates near 1 stay apart from small ones."""
    rng = np.random.default_rng(5)
    p1 = np.exp2(-rng.uniform(3, 16, 4000))
    p2 = np.where(rng.random(4000) < 0.6, np.minimum(1, p1 * np.exp2(rng.uniform(-3, 9, 4000))), 0)
    p0, classes = 1 / (v + 1), np.full(4000, 5)
    cells, n = np.unique(interpolation.cells_of(classes, p2, p1, p0), return_counts=True)
    got = interpolation.learn_weights(cells, n.astype(float))[5]
    want = np.full(3, 1 / 3)
    for _ in range(interpolation.ROUNDS):
        share = want * np.stack([p2, p1, np.full(4000, p0)], axis=1)
        want = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1e-3
        want /= want.sum()
    assert np.abs(got - want).max() < 0.01


def test_scores_beat_the_base_on_held_out_texts(spark, sf_dir):
    rows = interpolation.score(_common.documents(spark, sf_dir)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# --- fingerprints ---------------------------------------------------------------------------------------------------


def in_order(rows):
    return sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.mark.parametrize("stretch", [1 << 20, 700])
def test_fingerprints(docs, rows, stretch):
    got = by_id(simhash.fingerprint_documents(docs, chars=stretch))
    order = in_order(rows)
    same: dict = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(text) // 2
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[1][:half]).encode()).hexdigest()
        assert r.next_fp == got[after[0]].fp and same.setdefault(text, r.fp) == r.fp
    assert got[1].fp == [0, 0]


def test_fingerprints_of_few_rows(no_docs, twins, docs):
    assert simhash.fingerprint_documents(no_docs).count() == 0
    assert len(simhash.fingerprint_documents(twins).collect()) == 3
    one = simhash.fingerprint_documents(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].next_fp == one[0].fp


def test_radius_search_is_complete(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(20)]
    points = base + [b ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(6))) for b in base for _ in range(4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(n, [signed(p & (1 << 64) - 1), signed(p >> 64)]) for n, p in enumerate(points)], "id long, fp array<long>")
    got = {(r.query, r.match) for r in simhash.within_radius(table, table.where("id < 20")).collect()}
    rows = simhash.within_radius(table, table.where("id < 20")).count()
    assert got == {(a, b) for a in range(20) for b in range(len(points)) if (points[a] ^ points[b]).bit_count() <= 3} and rows == len(got)


# --- near-duplicates ------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words_of(text)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, linked):
    root = {i: i for i in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in points:
        for b in points:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in points}


def test_near_duplicates(docs, rows, no_docs, twins):
    got = by_id(simhash_dedup.near_duplicates(docs))
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    assert all(got[i].fp & (1 << 64) - 1 == p for i, p in prints.items())
    known = [i for i in prints if i is not None]
    want = plain_components(known, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: got[i].component_id for i in known} == want
    assert simhash_dedup.near_duplicates(no_docs).count() == 0
    assert sorted(r.component_id for r in simhash_dedup.near_duplicates(twins).collect())[:2] == [5, 5]


def test_masks_cover():
    masks = simhash_dedup.covering_masks(2, 12)
    for a in range(12):
        for b in range(12):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


@pytest.mark.parametrize("entry", [4096, 3])
def test_links_connect_all_pairs(spark, monkeypatch, entry):
    monkeypatch.setattr(simhash_dedup, "ENTRY", entry)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    points = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(25)})
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    tables = _common.Tables(spark, "t")
    found = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), tables)
    roots = {r.node: r.root for r in components.connected_components(found, tables).collect()}
    u = lambda x: x & (1 << 64) - 1
    assert {x: roots.get(x, x) for x in signed} == plain_components(signed, lambda a, b: (u(a) ^ u(b)).bit_count() <= 3)


def test_components_of_a_path(spark):
    rng = random.Random(9)
    names = rng.sample(range(1000), 40)
    edges = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(2000, 2001), (3, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), _common.Tables(spark, "t")).collect()}
    assert got == {n: min(names) for n in names} | {2000: 2000, 2001: 2000}


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_similar_texts(docs, rows, no_docs, twins):
    kept = {r.doc_id for r in similar_texts.deduplicate(docs).collect()}
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    want = plain_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert kept == set(want.values()) | {None}
    assert similar_texts.deduplicate(docs).columns == docs.columns
    assert similar_texts.deduplicate(no_docs).count() == 0 and sorted(r.doc_id for r in similar_texts.deduplicate(twins).collect())[0] == 5


def test_similar_texts_of_every_kind_of_edit(spark):
    """Cut short, extended, a block replaced or moved away: at 0.8 or a little more, all pairs are found."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(4000)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for n in range(160):
        size = (80, 120, 300, 1000)[n // 4 % 4]
        w = rng.choices(vocabulary, weights, k=size)
        other = rng.choices(vocabulary, weights, k=size)
        at = rng.randrange(size // 2)
        gone = size // 10 - 4  # a replaced block of b words costs b + 4 shingles of either text
        copy = (w[: size * 83 // 100], w + other[: size * 22 // 100], w[:at] + other[:gone] + w[at + gone :], w[size // 6 :])[n % 4]
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(copy))
        assert 0.8 <= len(a & b) / len(a | b) < 0.92
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(copy))]
    kept = {r.doc_id for r in similar_texts.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * n for n in range(160)}


def test_pages_of_one_frame(spark, monkeypatch):
    """Texts that share a frame and are no copies meet in bands, but their shingles are not dealt to one another."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    frame, rows = [word() for _ in range(130)], []
    for n in range(600):
        own = [word() for _ in range(70)]
        rows.append((n, " ".join(frame[:65] + own + frame[65:])))
    rows += [(600 + n, rows[n][1] + " " + " ".join(word() for _ in range(8))) for n in range(0, 600, 60)]
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert 0.4 < len(a & b) / len(a | b) < 0.5
    dealt = []
    compare = similar_texts._compare
    monkeypatch.setattr(similar_texts, "_compare", lambda members, *rest: dealt.extend(members.select("node", "size").collect()) or compare(members, *rest))
    kept = {r.doc_id for r in similar_texts.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(600))
    assert sum(-(-r.size // similar_texts.BLOCK) for r in dealt) <= len(rows) and max(r.size for r in dealt) < 100


def test_a_family_has_few_leaders():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 16, 400, dtype=np.uint8)
    signs = np.repeat(base[None], 2000, axis=0)
    for row in signs:
        row[rng.integers(0, 400, 8)] = 0
    leaders, links = similar_texts._Leaders(), []
    for at in range(0, 2000, 256):
        links += leaders.meet(np.arange(at, min(2000, at + 256)), signs[at : at + 256])
    assert len(leaders.nodes) < 5 and 1999 <= len(links) < 2100


def test_similar_links_across_blocks():
    rng = random.Random(6)
    sets = [np.unique(np.array([k * 1000 + rng.randrange(12) for _ in range(30)] + list(range(k % 3 * 50, k % 3 * 50 + 50)), np.uint64)) for k in range(12)]
    found = similar_texts.similar_links(sets[:6], sets[6:], 0.5)
    want = {(a, 6 + b) for a in range(6) for b in range(6) if len(np.intersect1d(sets[a], sets[6 + b])) >= 0.5 * len(np.union1d(sets[a], sets[6 + b]))}
    assert {tuple(sorted(p)) for p in found} <= want and (not want or found)


# --- repeated strings -----------------------------------------------------------------------------------------------


def plain_removal(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append(spans)
    return out


def test_anchors_are_hot_by_the_whole_table(spark, monkeypatch):
    """A passage that a few texts of every partition hold meets in joins, not in one task, though no batch has many."""
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(900)
    texts = [prose(300) + passage + prose(300) for _ in range(300)] + [prose(500) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60)
    met = []
    found = suffix_dedup._found
    monkeypatch.setattr(suffix_dedup, "_found", lambda leads: met.extend(r["count"] for r in leads.groupBy("anchor").count().collect()) or found(leads))
    got = suffix_dedup.remove_repeats(docs, lambda i, t, s: (i, str(s), len(t)), "doc_id long, spans string, n long").collect()
    assert max(met, default=0) < suffix_dedup.OFTEN
    assert {r.doc_id: r.spans for r in got} == {k: str(s) for k, s in enumerate(plain_removal([t.encode() for t in texts], 400))}


def test_documents_without_ids_are_many_stretches(spark):
    """Rows without an id, a third of all, are dealt over stretches, and the order of all is one."""
    rows = [(n if n % 3 else None, f"text {n * 7919 % 600} " * 20) for n in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = simhash.with_next(docs, chars=2000).where("own").withColumn("h", F.xxhash64("text")).collect()
    assert len(found) == 600 and len({r.stretch for r in found if r.doc_id is None}) > 10
    hashes = {r.text: r.h for r in found}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    nexts = {(r.doc_id, r.text): r.next_text for r in found}
    assert nexts == {(i, t): order[(k + 1) % 600][1] for k, (i, t) in enumerate(order)}


@pytest.mark.parametrize("zones", [1024, 1])
def test_repeats(docs, rows, monkeypatch, zones):
    monkeypatch.setattr(suffix_dedup, "ZONES", zones)
    monkeypatch.setattr(suffix_dedup, "OFTEN", 2 if zones == 1 else 16)  # every repeated anchor is hot
    texts = [(r[1] or "").encode() for r in rows]
    got = suffix_dedup.remove_repeats(docs, lambda i, t, s: (i, str(s), len(t)), "doc_id long, spans string, n long").collect()
    assert {r.doc_id: r.spans for r in got} == {r[0]: str(s) for r, s in zip(rows, plain_removal(texts, 400), strict=True)}


def test_repeats_at_small_lengths(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("ab") for _ in range(60))
    texts = [base[rng.randrange(30) :][: rng.randrange(40)] + "".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {n: str(s) for n, s in enumerate(plain_removal([t.encode() for t in texts], 12))}
    for zones, often in ((1024, 16), (2, 16), (1024, 2), (2, 2)):
        monkeypatch.setattr(suffix_dedup, "ZONES", zones)
        monkeypatch.setattr(suffix_dedup, "OFTEN", often)
        got = suffix_dedup.remove_repeats(df, lambda i, t, s: (i, str(s)), "doc_id long, spans string", length=12, anchor=6)
        assert {r.doc_id: r.spans for r in got.collect()} == want


def test_repeats_of_twins_and_of_nothing(no_docs, twins):
    use = lambda i, t, s: (i, len(t), sum(b - a for a, b in s))
    got = suffix_dedup.remove_repeats(twins, use, "doc_id long, n long, gone long").collect()
    assert len(got) == 3 and all(r.gone == r.n for r in got if r.doc_id == 5)
    assert suffix_dedup.remove_repeats(no_docs, use, "doc_id long, n long, gone long").count() == 0


def test_windows_from_the_transform():
    rng = random.Random(1)
    for _ in range(150):
        length, letters = rng.choice([2, 3, 5, 8]), rng.choice([1, 2, 20])
        bodies = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 8))]
        seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
        want = [[k for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1] for b in bodies]
        assert [x.tolist() for x in _bwt.repeated_windows(bodies, np.arange(len(bodies)) * 1000, length)] == want


# --- licenses -------------------------------------------------------------------------------------------------------


def test_license_scan(spark, no_docs):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(n))
    rows, want = [], set()
    for n, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        rows += [(n, f"{prose(37)}\n{text}\n{prose(50)}"), (100 + n, prose(60)), (200 + n, text.upper())]
        want |= {(n, name), (200 + n, name)}
    grant = license_scan.TEMPLATES["MIT-grant"].split(" ")
    rows += [(300, " ".join([*grant[:30], "new", *grant[31:]])), (301, " ".join(grant[: len(grant) // 2])), (302, None), (303, ""), (None, license_scan.TEMPLATES["MIT-notice"])]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert want <= found and (300, "MIT-grant") in found and (301, "MIT-grant") not in found and (None, "MIT-notice") in found
    assert not {r.doc_id for r in got} & {*range(100, 200), 302, 303} and all(r.containment >= 0.8 and r.begin_word < r.end_word for r in got)
    assert license_scan.scan(no_docs).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(no_docs, {"short": "too few words"})


def test_the_right_one_of_competing_licenses():
    names = ["GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "AGPL-3.0-header", "BSD-3-Clause", "CC-BY-4.0-notice", "CC-BY-NC-4.0-sentence", "CC-BY-SA-4.0-sentence", "GPL-2", "LGPL-2.1"]
    index = license_scan.Index(license_scan.TEMPLATES)
    for name in names:
        data = np.frombuffer(license_scan.TEMPLATES[name].encode(), np.uint8)
        found = license_scan.scan_shingles(index, *license_scan.shingles(data, np.array([0, len(data)])))
        assert [index.names[t] for _, t, *_ in found] == [name]


def test_bands_and_groups():
    assert (1 - 0.5) ** license_scan.bands_for(1, 1) <= 1e-4
    assert [len(g) for g in license_scan.groups_of({str(n): "a b c d e" for n in range(5)}, 10)] == [2, 2, 1]


# --- top k ----------------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 40))
    vectors[50:120] = vectors[0]  # a hot vector
    rows = [(n, v.astype(float).tolist()) for n, v in enumerate(vectors)] + [(None, [1.0] * 40), (900, None), (1000, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    bits = {n: [x is not None and x > 0 for x in v] + [False] * (40 - len(v)) for n, v in rows if n is not None and v is not None}
    for shard, block, few in ((1 << 20, 1 << 16, True), (64, 2, True), (64, 2, False), (1 << 20, 1, False)):
        monkeypatch.setattr(topk_hamming, "SHARD", shard)
        monkeypatch.setattr(topk_hamming, "BLOCK", block)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", few)  # else both sides may meet by chance
        got = topk_hamming.top_k(df, df.where("vec_id % 100 = 0"), 7).collect()
        for q in (0, 100, 200, 1000):
            want = sorted((sum(a != b for a, b in zip(bits[q], v, strict=True)), n) for n, v in bits.items())[:7]
            assert [(r.distance, r.match_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
        assert {r.query_id for r in got} == {0, 100, 200, 1000}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert topk_hamming.top_k(df.limit(0), df.limit(0)).count() == 0


def test_index_stops_when_covered():
    rng = np.random.default_rng(5)
    packed = rng.integers(0, 256, (4000, 8), dtype=np.uint8)
    index, sizes = topk_hamming.MultiIndex(packed), np.ones(4000, int)
    for n in range(30):
        query = packed[n].copy()
        query[n % 8] ^= 1 << (n % 8)
        apart = np.unpackbits(packed ^ query, axis=1).sum(axis=1)
        want = np.sort(apart)[:10].tolist()
        before = index.looked_up
        assert sorted(d for d, _ in index.nearest(index.values(query[None])[0], 10, sizes))[:10] == want
        assert index.looked_up - before < 4000 / 2  # the radius is proven by look-ups, far fewer than there are codes


def test_segments_of_any_width():
    rng = np.random.default_rng(6)
    for n, size in ((1, 1), (2, 3), (5, 8), (100, 5), (700, 2)):
        packed = np.unique(rng.integers(0, 256, (n, size), dtype=np.uint8), axis=0)
        index, sizes = topk_hamming.MultiIndex(packed), rng.integers(1, 4, len(packed))
        for query in rng.integers(0, 256, (10, size), dtype=np.uint8):
            d = np.unpackbits(packed ^ query, axis=1).sum(axis=1)
            order = np.argsort(d, kind="stable")
            reach = d[order][min(np.searchsorted(np.cumsum(sizes[order]), 9), len(d) - 1)]
            got = index.nearest(index.values(query[None])[0], 9, sizes)
            assert {(int(x), int(e)) for e, x in enumerate(d) if x <= reach} == set(got)


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality(spark, sf_dir, docs, no_docs):
    given = _common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.classify(given, labels).join(labels, "doc_id").collect()
    right = sum(r.accept == (r.quality == 1 and r.toxic == 0) for r in got)
    assert right / len(got) > 0.9
    none = labels.limit(0)
    assert all(r.accept for r in quality.classify(docs, none).collect()) and quality.classify(docs, none).count() == docs.count()
    assert quality.classify(no_docs, labels).count() == 0
    broken = spark.createDataFrame([(0, None, 1), (None, 1, 0), (0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, broken).count() == docs.count()


def test_sites_shrink(spark):
    rows = [(n, "text", "en", "big", 0) for n in range(50)] + [(99, "text", "en", "small", 0)]
    got = by_id(quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert abs(got[99].host_posterior - 0.5) < 1e-9 and abs(got[0].path_posterior - 0.5) < 1e-9


# --- chats ----------------------------------------------------------------------------------------------------------


def test_viterbi_over_parts_equals_the_whole(spark):
    rng = random.Random(4)
    text = lambda: "\n".join("".join(rng.choice("ab ?:") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 4)))
    entries = [(c, t, ("user", "assistant")[t % 2], text()) for c in (1, 2, 3) for t in range((3, 200, 5)[c - 1])] + [(None, 0, "user", None), (4, None, None, "User: hi"), (4, None, None, "User: hi")]
    df = spark.createDataFrame(entries, "conv_id long, turn long, role string, text string")
    model = chat_format.count_model(df)
    whole = chat_format.recover(df, model).collect()
    parts = chat_format.recover(df, model, part_bytes=300).collect()
    line = lambda r: (str(r.conv_id), str(r.turn), r.line, r.role, r.begins, r.text)
    assert sorted(map(line, whole)) == sorted(map(line, parts)) and len(whole) == sum(len((e[3] or "").split("\n")) for e in entries)
    assert chat_format.recover(df.limit(0), model).count() == 0


def test_markers():
    f = lambda s: chat_format.line_features(s, True)[0]
    assert [f("User: hi"), f("### Assistant"), f("<|system|> x"), f("Human: x"), f("use this"), f("A thing")] == [2, 3, 1, 2, 0, 0]
    assert chat_format.strip_marker("<|user|> hi") == "hi" and chat_format.render_turns([("user", False, "a"), ("user", False, "b"), ("assistant", True, "c")]) == "<|user|>\na\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n"


def test_roles_are_recovered(spark, sf_dir):
    rows = chat_format.op9_chat_format(spark, sf_dir).where("held_out").collect()
    assert rows and sum(r.given_role == r.recovered_role for r in rows) / len(rows) > 0.85



