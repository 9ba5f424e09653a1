"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens. The table of pieces (some bytes each) is
dealt by hash into packing tasks of about ``PIECES_A_TASK`` pieces. Each task packs online, in the order of the hash:
a fixed number of bins is open at once, kept in lists by free space, and a bitset says which lists hold bins. A piece
goes to the open bin with the least free space that holds it. When too many bins are open, the fullest closes.

Defined results: a null or empty text is one piece, the end token alone; a null document id is packed like any other;
repeated rows are packed each; of bins with as little free space the one that came to it last takes a piece; other columns are ignored,
whatever their names; an empty table gives an empty result. A text is tokenised whole, whatever its length.
"""

from __future__ import annotations

import array
import re
import sys
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import _common
from tracemill.llm.byte_bpe import byte_table

CAPACITY, END_ID = 4096, 1
OPEN_BINS, PIECES_A_TASK = 2048, 1 << 16
#: Longest word that is remembered, and how many words a worker remembers.
MEMO_CHARS, MEMO_WORDS = 48, 250_000
#: Words of printable ASCII and Latin-1 letters, without an apostrophe: for them lower-casing is one to one, they are
#: in composed form, and the tokenizer's pattern cuts them into runs of letters, single digits and runs of the rest.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _spaced(text: str) -> str:
    for c in "\n\t\r\v\f":
        if c in text:
            text = text.replace(c, " ")
    return text


class WordBPE:
    """Ids of texts under a tokenizer that drops white space: each word's ids are computed once and remembered.

    White space separates words for the tokenizer's pattern and its normaliser, so a text's ids are those of its words
    one after another. Only ASCII white space is cut here; a word may hold other white space and is encoded as it is.
    Plain words skip the library's normaliser and pattern: its merges are applied to their runs, which are remembered too.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = self.model.model
        self.memo: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.table = byte_table()

    def _run(self, run: str) -> bytes:
        spelt = run if run.isascii() else "".join([self.table[b] for b in run.encode()])
        ids = array.array("I", [t.id for t in self.merges.tokenize(spelt)]).tobytes()
        if len(run) <= MEMO_CHARS:
            self.runs[run] = ids
        return ids

    def _words(self, new: list[str]):
        """(word, ids) for each of the words."""
        runs, other = self.runs, []
        if len(runs) > MEMO_WORDS // 2:
            runs.clear()
        for word in new:
            if _PLAIN.fullmatch(word):
                yield word, b"".join([runs.get(r) or self._run(r) for r in _RUNS.findall(word.lower())])
            else:
                other.append(word)
        for word, got in zip(other, self.model.encode_batch_fast(other, add_special_tokens=False), strict=True):
            yield word, array.array("I", got.ids).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {"": b""}
        words = [_spaced(x).split(" ") for x in texts]
        memo, rare = self.memo, {}
        for word, ids in self._words(list(set().union(*words).difference(memo))):
            (memo if len(word) <= MEMO_CHARS else rare)[word] = ids
        if rare:
            memo = {**rare, **memo}
        return [b"".join(map(memo.__getitem__, x)) for x in words]


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; with_ids adds the ids."""
    end = np.asarray([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, pieces, starts, lengths, crcs, ids = [], *(array.array(c) for c in "iqqq"), []
        for row, data in enumerate(load(path).encode_batch(_common.texts_of(batch.column(1)))):
            data += end
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                rows.append(row)
                pieces.append(piece)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                crcs.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int64))
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_common.per_batch(cut), schema)


class BestFit:
    """Online best fit with a fixed number of open bins.

    ``open_at[f]`` lists the open bins with f tokens free; bit f of ``bits`` is set while that list holds any.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.count, self.next = 0, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its place there."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {self.capacity}")
        if room := self.bits >> length:
            free = length + (room & -room).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id, self.next = self.capacity, self.next, self.next + 1
        if left := free - length:
            if self.count == self.most:  # the fullest closes, be it this one
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest < left:
                    self._take(fullest)
                else:
                    return bin_id, self.capacity - free
            self.open_at[left].append(bin_id)
            self.bits |= 1 << left
            self.count += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        bin_id = self.open_at[free].pop()
        self.count -= 1
        if not self.open_at[free]:
            self.bits &= ~(1 << free)
        return bin_id


def pack(pieces: DataFrame, tasks: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to a table of pieces. Pieces are dealt by hash, so no document or source is hot.

    The order within a task is fixed by the rows alone: a task that runs again gives the same sequences.
    """
    names = [*pieces.columns, "sequence_id", "offset"]
    lengths_at = pieces.columns.index("length")

    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [fit.put(n) for n in batch.column(lengths_at).to_pylist()]
            more = [pa.array([base + b for b, _ in got], pa.int64()), pa.array([at for _, at in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names)

    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.withColumn("_order", order).repartition(tasks, "_order").sortWithinPartitions("_order", "doc_id", "piece", "length", "ids_crc32")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack. The table of pieces goes to the shared folder: its count sets the number of tasks."""
    tables = _common.Tables(docs.sparkSession, "pieces")
    pieces = tables.keep(tokenize_pieces(docs, path, capacity, end_id))
    return pack(pieces, _common.partitions(pieces.count(), PIECES_A_TASK), capacity, open_bins)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    _common.tune(spark)
    return pack_documents(_common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


assert sys.byteorder == "little" and array.array("I").itemsize == 4
