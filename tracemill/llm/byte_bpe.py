"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks. Each byte stands as one printable character (``byte_table``), so that a byte
vocabulary becomes a character vocabulary the library can merge. Decoding reverses that table, so an id that holds part
of a character decodes to its bytes and joins up with its neighbours.

The library orders merges by pairs, a rank file by what they make. The two differ only where two merges that make the
same token overlap: x, y, z with xy = yz and x != y. Such strings can be listed (``overlaps``); a piece that holds one is
merged by rank in ``_by_rank``, every other piece by the library. This takes for granted that every token's own bytes
merge into it, as in a trained rank file; then a merge never makes way for one of a lower rank.

Defined results: a null or empty text has no tokens; a null document id is returned as null; repeated rows are encoded
each; other columns of the input are ignored; an empty table gives an empty result; ties go by rank, then leftmost. Texts
of any length are encoded whole, a worker holding one batch and its longest text's tokens.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tracemill.llm import _common

#: Longest piece that is remembered, how many pieces a worker remembers, and how many are encoded as one text.
MEMO_CHARS, MEMO_PIECES, JOINED = 48, 400_000, 2048

#: A cut before a lone space between two visible characters: no match of the pattern spans it.
_CUT = re.compile(r"(?<=\S) (?=\S)")

def byte_table() -> list[str]:
    """The character for each byte: printable Latin-1 bytes stand for themselves, the others follow from code 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def overlaps(ranks: dict[bytes, int]) -> set[bytes]:
    """All xyz of which xy = yz is a token that both pairs make, and the pairs differ."""
    out = set()
    for token in ranks:
        for cut in range(1, len(token)):
            x, y = token[:cut], token[cut:]
            if x != y and x in ranks and y in ranks and token.startswith(y) and token[len(y) :] in ranks:
                out.add(x + token)
    return out


class ByteBPE:
    """A rank file as a tokenizers model, with its inverse."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        table = byte_table()
        spell = {token: "".join(table[b] for b in token) for token in ranks}
        merges = []
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
            for cut in range(1, len(token)):
                if token[:cut] in ranks and token[cut:] in ranks:
                    merges.append((spell[token[:cut]], spell[token[cut:]]))
        self.model = Tokenizer(models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.reverse = {c: b for b, c in enumerate(table)}
        self.bytes_of = {rank: bytes(self.reverse[c] for c in spell[token]) for token, rank in ranks.items()}
        self.digits_of = {rank: b"%d," % rank for rank in self.bytes_of}
        self.size_of = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        self.size_of[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        self.doubtful = overlaps(ranks)
        #: A doubtful string repeats itself after so many bytes, for so many bytes at least.
        self.periods: dict[int, int] = {}
        for text in self.doubtful:
            lag = next(k for k in range(1, len(text)) if text[k:] == text[:-k])
            self.periods[lag] = min(len(text) - lag, self.periods.get(lag, len(text)))
        self.memo: dict[str, tuple[int, bytes, bytes]] = {}

    def _may_doubt(self, data: bytes, ends: np.ndarray) -> list[int]:
        """Which of the pieces that end at ``ends`` may hold a doubtful string: a repetition that is long enough."""
        raw, found = np.frombuffer(data, np.uint8), []
        for lag, least in self.periods.items():
            if len(raw) >= lag + least:
                same = np.cumsum(np.r_[0, raw[lag:] == raw[:-lag]], dtype=np.int64)
                found.append(np.flatnonzero(same[least:] - same[:-least] == least))
        return np.unique(np.searchsorted(ends, np.concatenate(found), "right")).tolist() if found else []

    def _by_rank(self, word: bytes) -> list[int]:
        """One match of the pattern, merged by rank and, of equal ranks, from the left."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        end = [*range(1, len(word) + 1)]  # of the part that begins here; 0 where none does any more
        begin = [*range(-1, len(word))]  # of the part before the one that begins here
        heap = []

        def offer(a: int) -> None:
            if a >= 0 and (b := end[a]) < len(word) and (rank := self.ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

        for a in range(len(word)):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] == b and end[b] == c:  # both parts are as they were
                end[a], end[b] = c, 0
                if c < len(word):
                    begin[c] = a
                offer(begin[a])
                offer(a)
        out, at = [], 0
        while at < len(word):
            out.append(self.ranks[word[at : end[at]]])
            at = end[at]
        return out

    def _settle(self, text: str) -> list[int]:
        """A text by rank alone."""
        out = []
        for word, _ in self.model.pre_tokenizer.pre_tokenize_str(text):
            out += self._by_rank(bytes(self.reverse[c] for c in word))
        return out

    def _ids(self, pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The ids of pieces that are encoded as one text."""
        ids, raw = self.model.encode("".join(pieces), add_special_tokens=False).ids, [p.encode() for p in pieces]
        ends = np.cumsum([0, *map(len, raw)])
        at = np.searchsorted(np.cumsum(self.size_of[ids]), ends, "right").tolist()  # tokens that end by then
        doubt = {n for n in self._may_doubt(b"".join(raw), ends[1:]) if any(x in raw[n] for x in self.doubtful)}
        for n, piece in enumerate(pieces):
            yield piece, self._settle(piece) if n in doubt else ids[at[n] : at[n + 1]]

    def encoded(self, pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each piece with its ids. Pieces that begin with a lone space and end visibly split where they are joined."""
        joined = []
        for piece in pieces:
            if 1 < len(piece) <= MEMO_CHARS and piece[0] == " " and not piece[1].isspace() and not piece[-1].isspace():
                joined.append(piece)
            else:
                yield from self._ids([piece])
        for k in range(0, len(joined), JOINED):
            yield from self._ids(joined[k : k + JOINED])

    def pieces(self, text: str) -> list[str]:
        """The text cut where the pattern always cuts; every piece but the first begins with a space."""
        first, *rest = _CUT.split(text)
        return [first, *(" " + x for x in rest)] if rest else [first] if first else []

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """The ids of a text, and for each the code points it covers; tokens within one character share its place."""
        pieces = self.pieces(text)
        known = dict(self.encoded([*dict.fromkeys(pieces)]))
        ids = [i for p in pieces for i in known[p]]
        return ids, self.offsets(text, ids)

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """From the bytes of each id to the code points that they touch."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte: all but continuing bytes begin one
        ends = np.cumsum(self.size_of[ids])
        return list(zip(char[ends - self.size_of[ids]].tolist(), (char[ends - 1] + 1).tolist(), strict=True))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes whole: a character split over ids appears with the id that completes it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := decoder.decode(self.bytes_of[i]):
                yield out
        if out := decoder.decode(b"", True):
            yield out

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[int, bytes, bytes]]:
        """For each distinct piece: tokens, ids as decimal text with a comma after each, decoded bytes."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        out: dict[str, tuple[int, bytes, bytes]] = {}
        digits, spelt = self.digits_of, self.bytes_of
        for piece, ids in self.encoded([*set(pieces).difference(self.memo)]):
            value = (len(ids), b"".join([digits[i] for i in ids]), b"".join([spelt[i] for i in ids]))
            (self.memo if len(piece) <= MEMO_CHARS else out)[piece] = value
        return out


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and code-point offsets of each text."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            got = [bpe.encode(x) for x in _common.texts_of(batch.column(1))]
            ids = pa.array([g[0] for g in got], pa.list_(pa.int32()))
            starts = pa.array([[a for a, _ in g[1]] for g in got], pa.list_(pa.int32()))
            ends = pa.array([[b for _, b in g[1]] for g in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, starts, ends], ["doc_id", "ids", "starts", "ends"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each list of ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            text = [bpe.decode_bytes(x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text; return the number of tokens and digests of the ids and of the decoded bytes.

    A piece of text between two cuts is encoded once per worker and remembered while room lasts.
    """

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        cut = [bpe.pieces(x) for x in _common.texts_of(batch.column(1))]
        long_ones = bpe.learn(p for pieces in cut for p in pieces)
        memo, n, ids, decoded = bpe.memo, [], [], []
        for pieces in cut:
            got = [memo[p] if p in memo else long_ones[p] for p in pieces]
            n.append(sum(g[0] for g in got))
            ids.append(hashlib.sha256(b"".join([g[1] for g in got])[:-1]).hexdigest())
            decoded.append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_common.per_batch(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts through the multilingual rank file and back."""
    import public_tokenizers

    _common.tune(spark)
    return digest_documents(_common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
