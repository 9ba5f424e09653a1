"""Collocations: phrases of two to four words that stand together more often than their parts would.

First pass: a count-min sketch of all phrases of one to four words. It has ``ROWS`` rows of counters; a phrase adds to one
counter in each, so the least of its counters is never below its true count. Texts are gathered into blocks, and up to
``GROUP`` blocks of a task into a group; a group's partial sketch is the sorted list of counters that it adds to, and
partial sketches are merged by ranges of counters, each range in one task. The width follows the number of words, so the
sketch is as sharp on a large corpus as on a small one, and no task holds more than a range of it. A range answers each
group with those counters that the group has named and whose total reaches the least count.

Second pass: a block keeps the phrases whose counters all reach it (and whose beginnings do); their exact counts are added
up by phrase, within the group first, as numbers of the group's words. A group spells each of its phrases once and hands
them on as packed lists, one for each language, length and range of hashes, which are added up by their letters. A phrase
is in at most as many lists as it occurs, and the table that comes out has at most ``LONGEST`` / least rows for each word
of the input. Every phrase that reaches the least count is among them, whatever the collisions, and what a collision has let
through is dropped by its exact count. Parts of a frequent phrase are as frequent, so the scores need
nothing else. Scores are whole numbers in decimal arithmetic of 38 digits. A phrase goes if a longer one holds it and has
``SUBSUMED`` per cent of its count; the first ones of each language are found in three rounds, so that no task sorts a
language.

Defined results: a null text has no words; a null language is ``und``; words are compared as bytes after lower-casing A-Z;
ties of score and count go to the phrase first in byte order; repeated rows count each; ids and other columns are ignored,
whatever their names; an empty table gives an empty result. A text longer than a block is a block of its own, some hundred
bytes of memory for each of its words. A group sends a row to every range of the sketch; a range holds ``RANGE`` entries of
all groups, so rows grow with groups times ranges: some entries each up to about 10 TB of text, with groups of this size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm import _common
from tracemill.llm import _words as words
from tracemill.llm.interpolation import pack, small, unpack

U = np.uint64
LONGEST, LEAST, SUBSUMED, SCALE, FIRST = 4, 30, 80, 2_000_000, 2000
#: Words of one block; blocks of one group; rows of the sketch; entries of all groups in one range of counters.
BLOCK, GROUP, ROWS, RANGE = 3 << 18, 8, 2, 4 << 20
#: Ranges of a sketch's row to one range of the phrases of a language and length.
RANGES = 16
SALTS = np.array([0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47], U)
#: Kinds of bytes: of a word, between words, between pieces.
WORD, BLANK, CUT = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = BLANK
_KINDS[[*b".,;:!?\n\x0b\x0c\r"]] = CUT
#: Phrases are ranked in so many parts of each language at first, then in so many.
DEALT = (4096, 64)


class Words:
    """The words of a stretch of texts, as strings, with the text that each is in and whether it begins a piece."""

    def __init__(self, data: np.ndarray, row_at: np.ndarray):
        data = words.lower_ascii(data)
        kind = _KINDS[data]
        inside = np.r_[kind == WORD, False]
        edge = np.zeros(len(data) + 1, bool)
        edge[row_at] = True
        before = np.r_[False, inside[:-1]]
        start = np.flatnonzero(inside & (edge | ~before))
        end = np.flatnonzero(before & (edge | ~inside))
        self.row = np.searchsorted(row_at, start, "right") - 1
        cuts = np.r_[0, np.cumsum(kind == CUT, dtype=np.int64)][start]
        first = np.ones(len(start), bool)
        first[1:] = (cuts[1:] != cuts[:-1]) | (self.row[1:] != self.row[:-1])
        self.first = first
        offsets = np.r_[0, np.cumsum(end - start)]
        self.text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside[:-1]])))


def blocks_of(docs: DataFrame) -> DataFrame:
    """part_of, langs, lang_words, vocab, lengths, tokens, lang, first: texts as words of the block's vocabulary, the most
    frequent word first; part_of is the block's group."""
    names = ["part_of", "langs", "lang_words", "vocab", "lengths", "tokens", "lang", "first"]
    schema = "part_of string, langs array<string>, lang_words array<long>, vocab binary, lengths binary, tokens binary, lang binary, first binary"

    def flush(group, texts, langs, firsts) -> pa.RecordBatch:
        found = pa.chunked_array(texts, pa.large_string()).combine_chunks().dictionary_encode()
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        tokens = found.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(tokens, minlength=len(found.dictionary)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        kinds = pa.chunked_array(langs, pa.string()).dictionary_encode().combine_chunks()
        kinds = kinds.chunk(0) if isinstance(kinds, pa.ChunkedArray) else kinds
        lang = kinds.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
        data, at = _common.utf8_of(found.dictionary.take(pa.array(order)))
        vocab = zstandard.ZstdCompressor(level=1).compress(bytes(data[at[0] : at[-1]]))
        counts = np.bincount(lang, minlength=len(kinds.dictionary)).tolist()
        row = [group, kinds.dictionary.to_pylist(), counts, vocab, pack(np.diff(at).astype(np.uint32)), pack(rank[tokens]), pack(lang), pack(np.packbits(np.concatenate(firsts)))]
        types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]):
        texts, langs, firsts, size = [], [], [], 0
        group, blocks = uuid.uuid4().hex, 0
        for batch in batches:
            data, at = _common.utf8_of(batch.column(1))
            data = np.frombuffer(data, np.uint8)
            for first, end in words.chunks(at):
                found = Words(data[at[first] : at[end]], np.array(at[first : end + 1]) - at[first])
                if not len(found.text):
                    continue
                texts.append(found.text)
                langs.append(batch.column(0).slice(first, end - first).take(pa.array(found.row)))
                firsts.append(found.first)
                size += len(found.text)
                if size >= BLOCK:
                    yield flush(group, texts, langs, firsts)
                    texts, langs, firsts, size = [], [], [], 0
                    blocks += 1
                    if blocks % GROUP == 0:
                        group = uuid.uuid4().hex
        if size:
            yield flush(group, texts, langs, firsts)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Block:
    """A block's distinct phrases, level by level: each is a phrase of one word less and a word."""

    def __init__(self, row: dict):
        self.langs = row["langs"]
        lengths = unpack(row["lengths"]).astype(np.int64)
        data = zstandard.ZstdDecompressor().decompress(row["vocab"])
        at = np.r_[0, np.cumsum(lengths)]
        self.vocab = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
        word_hash = words.Prefix(np.frombuffer(data, np.uint8)).of(at[:-1], at[1:])
        raw = [x.encode() for x in self.langs]
        lang_at = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        lang_hash = words.Prefix(np.frombuffer(b"".join(raw), np.uint8)).of(lang_at[:-1], lang_at[1:])
        tokens, lang = unpack(row["tokens"]).astype(U), unpack(row["lang"]).astype(U)
        n = len(tokens)
        first = np.unpackbits(unpack(row["first"]))[:n].astype(bool)
        begins = np.flatnonzero(first)
        left = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n])) - np.arange(n)  # words from here to the piece's end
        at_, key = np.arange(n), lang << U(32) | tokens
        self.parent, self.word, self.count, self.hash = [], [], [], []
        above = lang_hash
        for k in range(1, LONGEST + 1):
            distinct, node, count = np.unique(key, return_inverse=True, return_counts=True)
            self.parent.append((distinct >> U(32)).astype(np.int64))
            self.word.append((distinct & U(0xFFFFFFFF)).astype(np.int64))
            self.count.append(count)
            self.hash.append(words.pair(above[self.parent[-1]], word_hash[self.word[-1]]))
            above = self.hash[-1]
            more = left[at_] > k
            at_ = at_[more]
            key = node[more].astype(U) << U(32) | tokens[at_ + k]

    def counters(self, row: int, bits: int) -> np.ndarray:
        """The counter of a sketch's row that each phrase has."""
        return words.mix(np.concatenate(self.hash) ^ SALTS[row]) >> U(64 - bits)

    def kept(self, alive: np.ndarray):
        """Level by level (parent, word, count, hash) of the phrases that are alive and whose beginnings are; a parent is a
        place among what is kept of the level above, at first a language."""
        cuts = np.cumsum([len(c) for c in self.count])[:-1]
        above, place = None, None
        for k, mine in enumerate(np.split(alive, cuts)):
            mine = mine if k == 0 else mine & above[self.parent[k]]
            at = np.flatnonzero(mine)
            parent = self.parent[k][at]
            yield parent if k == 0 else place[parent], self.word[k][at], self.count[k][at], self.hash[k][at]
            above, place = mine, np.cumsum(mine) - 1


def _renumbered(lists: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of all lists, and for each list the numbers of its values among them."""
    found = pa.concat_arrays(lists).dictionary_encode()
    return found.dictionary, np.split(found.indices.to_numpy(zero_copy_only=False).astype(U), np.cumsum([len(x) for x in lists])[:-1])


def spelled(blocks: list[tuple[list[str], pa.Array, list[tuple]]]):
    """Level by level (langs, lang, phrase, count, hash) of what a group's blocks keep, each phrase once.

    blocks: languages, words and levels as ``Block.kept`` has them."""
    langs, above = _renumbered([pa.array(langs, pa.string()) for langs, _, _ in blocks])
    vocab, words_of = _renumbered([vocab for _, vocab, _ in blocks])
    texts, lang = None, None
    for k in range(LONGEST):
        levels = [levels[k] for _, _, levels in blocks]
        key = np.concatenate([up[parent] << U(32) | of[word] for up, of, (parent, word, _, _) in zip(above, words_of, levels, strict=True)])
        distinct, node = np.unique(key, return_inverse=True)
        count, hashes = np.zeros(len(distinct), np.int64), np.empty(len(distinct), U)
        np.add.at(count, node, np.concatenate([x[2] for x in levels]))
        hashes[node] = np.concatenate([x[3] for x in levels])
        above = np.split(node.astype(U), np.cumsum([len(x[0]) for x in levels])[:-1])
        up, word = (distinct >> U(32)).astype(np.int64), vocab.take(pa.array((distinct & U(0xFFFFFFFF)).astype(np.int64)))
        if k == 0:
            texts, lang = word, up
        else:
            texts, lang = pc.binary_join_element_wise(texts.take(pa.array(up)), word, pa.scalar(" ", pa.large_string())), lang[up]
        yield langs, lang, texts, count, hashes


def _bounds(counters: np.ndarray, bits: int, parts: int) -> np.ndarray:
    width = (1 << bits) // parts
    return np.searchsorted(counters, np.arange(parts + 1, dtype=np.int64).astype(U) * U(width))


def _summed(counters: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct counters, sorted, and the sum of each."""
    order = np.argsort(counters)
    counters = counters[order]
    first = np.flatnonzero(np.r_[True, counters[1:] != counters[:-1]][: len(counters)])
    return counters[first], np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64)


def partial_sketches(blocks: DataFrame, bits: int, parts: int) -> DataFrame:
    """part, part_of, counters, n: for each range of a sketch's row what each group adds there."""
    width = (1 << bits) // parts

    def flush(group: str, held: list) -> Iterable[pa.RecordBatch]:
        for r in range(ROWS):
            cut = [(counters, n, _bounds(counters, bits, parts)) for counters, n in (row[r] for row in held)]
            part, terms, sums = [], [], []
            for p in range(parts):  # blocks are merged range by range, so that little is held twice
                counters = np.concatenate([c[at[p] : at[p + 1]] for c, _, at in cut])
                if len(counters):
                    counters, n = _summed(counters, np.concatenate([n[at[p] : at[p + 1]].astype(np.int64) for _, n, at in cut]))
                    part.append(r * parts + p)
                    terms.append(pack(np.diff(counters, prepend=counters.dtype.type(p * width)).astype(np.uint32)))
                    sums.append(pack(small(n)))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([group] * len(part)), pa.array(terms, pa.binary()), pa.array(sums, pa.binary())], ["part", "part_of", "counters", "n"])

    def run(batches: Iterable[pa.RecordBatch]):
        group, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and row["part_of"] != group:
                    yield from flush(group, held)
                    held = []
                group, b = row["part_of"], Block(row)
                every, narrow = np.concatenate(b.count), np.uint32 if bits <= 32 else U
                held.append([(c, small(n)) for c, n in (_summed(b.counters(r, bits).astype(narrow), every) for r in range(ROWS))])
        if held:
            yield from flush(group, held)

    return blocks.mapInArrow(run, "part long, part_of string, counters binary, n binary")


def merged(partial: DataFrame, width: int, least: int) -> DataFrame:
    """part, part_of, reached: of the counters that a group has named those of which the sum of all groups reaches least."""

    def run(table: pa.Table) -> pa.Table:
        named = [np.cumsum(unpack(x), dtype=np.int64) for x in table.column("counters").to_pylist()]
        total = np.zeros(width, np.int64)
        for at, n in zip(named, table.column("n").to_pylist(), strict=True):
            total[at] += unpack(n).astype(np.int64)
        reached = total >= least
        lists = [pack(np.diff(at[reached[at]], prepend=0).astype(np.uint32)) for at in named]
        return pa.table({"part": table.column("part"), "part_of": table.column("part_of"), "reached": pa.array(lists, pa.binary())})

    return partial.groupBy("part").applyInArrow(run, "part long, part_of string, reached binary")


def survivors(blocks: DataFrame, reached: DataFrame, bits: int, parts: int) -> DataFrame:
    """lang, phrase, words, lengths, texts, n: what the sketch lets through, counted in each group and spelled once; a row
    has a group's phrases of one language, length and range of hashes (phrase is the range) in packed lists."""
    width, ranges = (1 << bits) // parts, max(1, parts // RANGES)
    names = ["lang", "phrase", "words", "lengths", "texts", "n"]
    types = [pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 3]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[list[np.ndarray]] = [[np.empty(0, U)] for _ in range(ROWS)]
        for part, gaps in zip(right.column("part").to_pylist(), right.column("reached").to_pylist(), strict=True):
            got[part // parts].append(np.cumsum(unpack(gaps), dtype=U) + U(part % parts * width))
        often = [np.unique(np.concatenate(x)) for x in got]
        sieve = np.zeros((ROWS, 1 << 22), bool)  # most counters are told apart by their last bits
        for r in range(ROWS):
            sieve[r, often[r] & U((1 << 22) - 1)] = True
        held = []
        for k in range(left.num_rows):
            b = Block(left.slice(k, 1).to_pylist()[0])
            alive = np.ones(sum(len(c) for c in b.count), bool)
            for r in range(ROWS):
                counters = b.counters(r, bits)
                alive &= sieve[r, counters & U((1 << 22) - 1)]
                at = np.flatnonzero(alive)
                alive[at] = np.isin(counters[at], often[r])
            levels = list(b.kept(alive))
            used = np.unique(np.concatenate([word for _, word, _, _ in levels]))
            levels = [(parent, np.searchsorted(used, word), count, hashes) for parent, word, count, hashes in levels]
            held.append((b.langs, b.vocab.take(pa.array(used)), levels))
        out = []
        for size, (langs, lang, texts, count, hashes) in enumerate(spelled(held), 1):
            cell = lang * ranges + (hashes % U(ranges)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            data, at = _common.utf8_of(texts.take(pa.array(order)))
            at, cell, count = np.array(at), cell[order], count[order]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=False):
                packed = zstandard.ZstdCompressor(level=3).compress(data[at[i] : at[j]])
                out.append((langs[cell[i] // ranges].as_py(), cell[i] % ranges, size, pack(small(np.diff(at[i : j + 1]))), packed, pack(small(count[i:j]))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)

    return blocks.groupBy("part_of").cogroup(reached.groupBy("part_of")).applyInArrow(run, "lang string, phrase long, words int, lengths binary, texts binary, n binary")


def added_up(found: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words, a: the phrases of packed lists whose counts reach least in all; lists are added up some at a time."""

    def run(table: pa.Table) -> pa.Table:
        total, texts, lengths, counts, size = [], [], [], [], 0

        def settle() -> None:
            at = np.r_[0, np.cumsum(np.concatenate(lengths), dtype=np.int64)]
            phrase = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(b"".join(texts)))
            both = pa.concat_tables([*total, pa.table({"phrase": phrase, "a": pa.array(np.concatenate(counts))})])
            total[:] = [both.group_by("phrase").aggregate([("a", "sum")]).select(["phrase", "a_sum"]).rename_columns(["phrase", "a"])]

        for row in table.select(["lengths", "texts", "n"]).to_batches(max_chunksize=1):
            size_of, text, n = (x[0].as_py() for x in row.columns)
            texts.append(zstandard.ZstdDecompressor().decompress(text))
            lengths.append(unpack(size_of).astype(np.int64))
            counts.append(unpack(n).astype(np.int64))
            size += len(counts[-1])
            if size >= RANGE:
                settle()
                texts, lengths, counts, size = [], [], [], 0
        if size:
            settle()
        often = total[0].filter(pc.field("a") >= least)
        one = lambda name: pa.array([table.column(name)[0].as_py()] * len(often), table.schema.field(name).type)
        return pa.table({"lang": one("lang"), "phrase": often.column("phrase").cast(pa.string()), "words": one("words"), "a": often.column("a")})

    return found.groupBy("lang", "words", "phrase").applyInArrow(run, "lang string, phrase string, words int, a long")


def width_of(total: int) -> int:
    """The bits of a counter's number: the power of two nearest to the number of words, about four phrases on each counter."""
    return max(16, round(math.log2(max(total, 1))))


def frequent_phrases(docs: DataFrame, tables: _common.Tables, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, a: phrases of 1 to 4 words that occur at least so often; and lang, n: words of each language."""
    blocks = tables.keep(blocks_of(docs))
    counted = tables.keep(blocks.select(F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("lang_words").alias("n")))).groupBy("lang").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    bits = width_of(int(total))
    parts = 1 << max(3, (LONGEST * int(total) // RANGE).bit_length())
    parts = min(parts, 1 << (bits - 10))
    reached = merged(partial_sketches(blocks, bits, parts), (1 << bits) // parts, least)
    found = survivors(blocks, reached, bits, parts)
    return tables.keep(added_up(found, least)), counted


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score: each candidate at its lowest-scoring cut."""
    cuts = frequent.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right"))
    part = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    both = both.withColumn("score", F.expr(f"(cast(a as decimal(19,0)) * cast({SCALE} as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    order = F.col("score") * 4 + F.col("k")
    return both.groupBy("lang", "phrase", "words", "a").agg(F.min_by("l", order).alias("l"), F.min_by("r", order).alias("r"), F.min("score").alias("score"))


def without_subsumed(candidates: DataFrame, frequent: DataFrame, per_cent: int = SUBSUMED) -> DataFrame:
    """candidates that no longer phrase holds with so large a share of their count."""
    inner = lambda i, m: F.substring_index(F.substring_index("phrase", " ", i + m), " ", -m)
    of = {n: F.array(*(inner(i, m) for m in range(2, n) for i in range(n - m + 1))) for n in range(3, LONGEST + 1)}
    within = F.when(F.col("words") == 3, of[3])
    for n in range(4, LONGEST + 1):
        within = within.when(F.col("words") == n, of[n])
    held = frequent.where("words > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    gone = _exact("most") * 100 >= _exact("a") * per_cent
    return candidates.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | ~gone).drop("most")


def first_ranked(scores: DataFrame, first: int = FIRST) -> DataFrame:
    """The first of each language, with their rank."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    out = scores.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT[0])))
    for parts in DEALT:
        out = out.withColumn("dealt", F.col("dealt") % parts)
        out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= first)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)


def mine(docs: DataFrame, least: int = LEAST, per_cent: int = SUBSUMED, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    tables = _common.Tables(docs.sparkSession, "collocations")
    frequent, counted = frequent_phrases(docs, tables, least)
    kept = without_subsumed(scored(frequent), frequent, per_cent)
    return first_ranked(kept, first).join(counted, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language, over all whole texts."""
    _common.tune(spark)
    return mine(_common.documents(spark, sf_dir))


OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(piece, '[ \\t]+') AS raw
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM documents WHERE text IS NOT NULL)
), split AS (
  SELECT lang, list_filter(raw, lambda x: x <> '') AS words FROM pieces
), counted AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM split WHERE len(words) > 0 GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4])::INT AS k) WHERE len(words) >= k
), frequent AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, f.a AS l, g.a AS r, (2000000::HUGEINT * c.a // (f.a::HUGEINT + g.a))::BIGINT AS score
  FROM cuts c JOIN frequent f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN frequent g ON g.lang = c.lang AND g.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))) AS phrase
  FROM frequent, (SELECT unnest([2, 3])::INT AS m) WHERE k > m AND k > 2
), held AS (
  SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT l.* FROM lowest l LEFT JOIN held h ON h.lang = l.lang AND h.phrase = l.phrase WHERE h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * l.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, c.n, k.score FROM ranked k JOIN counted c ON c.lang = k.lang WHERE k.rank <= 2000
"""
