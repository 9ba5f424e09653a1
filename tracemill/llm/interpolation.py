"""Deleted interpolation: a bigram language model whose parts are mixed by the frequency of the context.

P(w | u) = l2 * c(u w) / c(u) + l1 * c(w) / N + l0 / (V + 1), with weights (l2, l1, l0) for each class of c(u) (its
binary logarithm). The weights are learned by expectation-maximisation on held-out counts: every training document is
held out in turn, its own counts deleted from the corpus counts that predict it.

Counts travel as packed arrays, not as rows of words. Documents are gathered into blocks of about ``BLOCK`` tokens. A
block sends, to each of P partitions of the hash range, the sorted hashes of its distinct words and bigrams with their
counts in training documents: each term once per block, so no term is hot. A partition adds up all blocks' counts and
answers each block with the totals, in the order of the question. Blocks, and then scores, follow from the answers.

What EM sees is a table of how often each cell (class of context, binned ratios of the three estimates) occurs. The bins
span every ratio that can occur, so none is cut off; an estimate lies between 1 / N and 1, so at most 4 log2(N) + 2 bins
of each kind are in use, and what reaches the driver grows with the square of the logarithm of the corpus.

Words are known by 64-bit hashes. Defined results: a null or empty text is one end token; a document with a null id is
held out (it belongs to no fold); repeated rows count each; ties do not arise; other columns are ignored, whatever their
names; an empty table gives an empty result; without training documents N and V are 0 and every token is unknown. A text
longer than a block is a block of its own, some tens of bytes of memory for each of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import _common
from tracemill.llm import _words as words

U = np.uint64
BLOCK = 1 << 20
#: Terms of all blocks that one partition of the hash range adds up.
TERMS_A_PARTITION = 4 << 20
#: A class of contexts for each power of two that a count of 64 bits can have. Bins of a quarter of a power of two, 255 each way from ratio 1 (bin ONE), the least ones wrapped to the end: no count
#: of 64 bits leaves them. Bin 0 is an estimate of zero.
CLASSES, BINS, BIN, ONE = 65, 512, 0.25, 64
END = U(0x5E3779B97F4A7C15)
#: The context before the first word.
START = U(0x1B873593CC9E2D51)
ROUNDS = 40


def pack(a: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.char.encode() + np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    dtype = np.dtype(raw[:1].decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def small(a: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest type."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def in_training(doc_id: int | None, folds: int, held_fold: int) -> bool:
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % folds != held_fold


def blocks_of(docs: DataFrame, folds: int, held_fold: int) -> DataFrame:
    """block, ids, train, counts, vocab, tokens: packed columns; tokens index the block's sorted vocabulary of hashes."""

    def flush(ids, hashes, counts) -> pa.RecordBatch:
        train = np.array([in_training(i, folds, held_fold) for i in ids], np.uint8)
        vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        known = np.array([i is not None for i in ids], np.uint8)
        row = [uuid.uuid4().hex, pack(np.array([i or 0 for i in ids], np.int64)), pack(known), pack(train), pack(np.concatenate(counts).astype(np.uint32)), pack(np.diff(vocab, prepend=U(0))), pack(tokens.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "ids", "known", "train", "counts", "vocab", "tokens"])

    def run(batches: Iterable[pa.RecordBatch]):
        ids, hashes, counts, size = [], [], [], 0
        for batch in batches:
            data, at = _common.utf8_of(batch.column(1))
            data = np.frombuffer(data, np.uint8)
            names = batch.column(0).to_pylist()
            for first, end in words.chunks(at):
                row_at = np.array(at[first : end + 1]) - at[first]
                h, n = words.word_hashes(data[at[first] : at[end]], row_at)
                ends = np.cumsum(n)
                hashes.append(np.insert(h, ends, END))
                counts.append(n + 1)
                ids += names[first:end]
                size += len(h) + len(n)
                if size >= BLOCK:
                    yield flush(ids, hashes, counts)
                    ids, hashes, counts, size = [], [], [], 0
        if ids:
            yield flush(ids, hashes, counts)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "block string, ids binary, known binary, train binary, counts binary, vocab binary, tokens binary")


class Block:
    """A block's tokens as terms: distinct words, then distinct bigrams, each sorted by hash."""

    def __init__(self, row: dict):
        self.ids, self.known = unpack(row["ids"]), unpack(row["known"]).astype(bool)
        self.train = unpack(row["train"]).astype(bool)
        self.counts = unpack(row["counts"]).astype(np.int64)
        self.vocab = np.cumsum(unpack(row["vocab"]), dtype=U)
        self.tokens = unpack(row["tokens"])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        first = np.cumsum(self.counts) - self.counts
        h = self.vocab[self.tokens]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[first] = START
        self.first = first
        self.pairs, self.pair_of = np.unique(words.pair(before, h), return_inverse=True)

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hashes and counts in training documents, of words and of bigrams."""
        weight = self.train[self.doc].astype(np.int64)
        return [(h, np.bincount(of, weight, len(h)).astype(np.int64)) for h, of in ((self.vocab, self.tokens), (self.pairs, self.pair_of))]


def part_bounds(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition of the hash range begins in sorted hashes."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], U)
    return np.r_[0, np.searchsorted(h, edges), len(h)]


def questions(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for kind, (h, n) in enumerate(Block(row).asked()):
                    at = part_bounds(h, parts)
                    for p in range(parts):
                        a, b = at[p], at[p + 1]
                        if a < b:
                            out.append((p, kind, row["block"], pack(np.diff(h[a:b], prepend=U(0))), pack(small(n[a:b]))))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], ["part", "kind", "block", "terms", "n"])

    return blocks.mapInArrow(run, "part int, kind int, block string, terms binary, n binary")


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """For each question the totals over all blocks; and one row per partition and kind with block null: N and V."""

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "terms", "n"]).to_pylist()
        terms = [np.cumsum(unpack(r["terms"]), dtype=U) for r in rows]
        n = [unpack(r["n"]).astype(np.int64) for r in rows]
        every, where = np.unique(np.concatenate(terms), return_inverse=True)
        total = np.bincount(where, np.concatenate(n), len(every)).astype(np.int64)
        out, at = [], 0
        for t in terms:
            out.append(pack(small(total[where[at : at + len(t)]])))
            at += len(t)
        size = len(rows)
        key = [table.column(c)[0].as_py() for c in ("part", "kind")]
        return pa.table({"part": pa.array([key[0]] * (size + 1), pa.int32()), "kind": pa.array([key[1]] * (size + 1), pa.int32()), "block": pa.array([*(r["block"] for r in rows), None], pa.string()), "totals": pa.array([*out, b""], pa.binary()), "n": pa.array([0] * size + [int(total.sum())], pa.int64()), "v": pa.array([0] * size + [int((total > 0).sum())], pa.int64())})

    return asked.groupBy("part", "kind").applyInArrow(add_up, "part int, kind int, block string, totals binary, n long, v long")


class Estimates:
    """What the model needs at each token of a block."""

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int):
        self.block, self.n, self.v = block, n, v
        word, pair = totals
        self.c = word[block.tokens].astype(np.float64)
        self.pair = pair[block.pair_of].astype(np.float64)
        self.starts = None

    def contexts(self, starts: int) -> np.ndarray:
        """c(u): how often the word before occurs; before the first word, the number of training documents."""
        out = np.empty_like(self.c)
        out[1:] = self.c[:-1]
        out[self.block.first] = starts
        return out


def _within(doc: np.ndarray, term: np.ndarray) -> np.ndarray:
    """How often each token's term occurs in its own document."""
    _, of, n = np.unique(doc.astype(U) << U(32) | term.astype(U), return_inverse=True, return_counts=True)
    return n[of].astype(np.float64)


def _parts(pair, context, c, n, v):
    """The three estimates."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return p2, c / np.maximum(n, 1), 1.0 / (v + 1)


def context_class(context: np.ndarray) -> np.ndarray:
    """0 if the context is new; else 1 and its binary logarithm."""
    return np.where(context > 0, np.minimum(CLASSES - 1, 1 + np.log2(np.maximum(context, 1)).astype(int)), 0)


def _cells(est: Estimates, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the training documents' tokens, each document's own counts deleted, and how often each occurs."""
    b = est.block
    own_c, own_pair = _within(b.doc, b.tokens), _within(b.doc, b.pair_of)
    own_context = np.empty_like(own_c)
    own_context[1:] = own_c[:-1]
    own_context[b.first] = 1
    keep = b.train[b.doc]
    p2, p1, p0 = _parts((est.pair - own_pair)[keep], (est.contexts(starts) - own_context)[keep], (est.c - own_c)[keep], (est.n - b.counts[b.doc])[keep], est.v)
    return np.unique(cells_of(context_class((est.contexts(starts) - own_context)[keep]), p2, p1, p0), return_counts=True)


def cells_of(classes: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float) -> np.ndarray:
    """The cell of each token: class, and the bins of both estimates; bin 0 is an estimate of zero."""

    def bin_of(p):
        return np.where(p > 0, 1 + (np.round(np.log2(np.where(p > 0, p, p0) / p0) / BIN) + ONE - 1) % (BINS - 1), 0).astype(np.int64)

    return (classes * BINS + bin_of(p2)) * BINS + bin_of(p1)


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """(CLASSES, 3) weights by expectation-maximisation over the cells."""
    classes, rest = np.divmod(cells, BINS * BINS)
    b2, b1 = np.divmod(rest, BINS)
    half = BINS // 2 - 1
    ratio = [np.where(b > 0, np.exp2(((b - ONE + half) % (BINS - 1) - half) * BIN), 0.0) for b in (b2, b1)] + [np.ones(len(cells))]
    p = np.stack(ratio, axis=1)
    weights = np.full((CLASSES, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(rounds):
        share = weights[classes] * p
        share *= (counts / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(classes, share[:, k], CLASSES) for k in range(3)], axis=1) + 1e-3
        new[0, 0] = 0
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _each_block(blocks: DataFrame, answered: DataFrame, parts: int, n: int, v: int, use, schema: str) -> DataFrame:
    """use(Estimates) for each block, with its answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        got: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
        for r in right.select(["kind", "part", "totals"]).to_pylist():
            got[r["kind"]].append((r["part"], r["totals"]))
        totals = [np.concatenate([unpack(t).astype(np.int64) for _, t in sorted(got[k])]) for k in (0, 1)]
        return use(Estimates(Block(rows[0]), totals, n, v))

    told = answered.where("block is not null").select("block", "kind", "part", "totals")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    tables = _common.Tables(docs.sparkSession, "interpolation")
    blocks = tables.keep(blocks_of(docs, folds, held_fold))
    facts = blocks.agg(F.sum(F.octet_length("tokens") + F.octet_length("vocab"))).first()[0] or 0
    parts = _common.partitions(facts / 4, TERMS_A_PARTITION, 8, 1 << 14)
    answered = tables.keep(answers(questions(blocks, parts), parts))
    sums = answered.where("block is null and kind = 0").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    starts = _starts(docs, folds, held_fold)

    def cells(est: Estimates) -> pa.Table:
        cell, count = _cells(est, starts)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(count, pa.int64())})

    seen = _each_block(blocks, answered, parts, n, v, cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = seen.toPandas()  # at most CLASSES * (4 log2(N) + 2) ** 2 rows
    weights = learn_weights(found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.float64))

    def scores(est: Estimates) -> pa.Table:
        b = est.block
        p2, p1, p0 = _parts(est.pair, context := est.contexts(starts), est.c, n, v)
        w = weights[context_class(context)]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((est.c + 0.5) / (n + 0.5 * (v + 1)))
        docs_n = len(b.counts)
        add = lambda x: np.bincount(b.doc, x, docs_n)
        return pa.table({"doc_id": pa.array(b.ids, mask=~b.known), "held_out": pa.array(~b.train), "n_tokens": pa.array(b.counts), "n_known": pa.array(add(est.c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(docs_n, n, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(model))})

    return _each_block(blocks, answered, parts, n, v, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _starts(docs: DataFrame, folds: int, held_fold: int) -> int:
    """Training documents: each begins once."""
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds
    return docs.where(F.col("doc_id").isNotNull() & (fold != held_fold)).count()


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts, learned from those whose crc32(doc_id) mod 5 is not 1."""
    _common.tune(spark)
    return score(_common.documents(spark, sf_dir))
