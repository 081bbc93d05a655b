"""Byte-level BPE: text to token ids and back, by the tokenizers library over Arrow batches.

Texts are cut by a pattern, each match is mapped from bytes to printable characters (one character for each of the
256 byte values) and merged by a `tokenizers` BPE model whose merges come from the rank file. A rank file says which
tokens two parts may become, not which two parts: where two places overlap that would become the same token, the
leftmost goes first, which a list of merges cannot say. That takes a stretch in which something stands twice and begins
a third time, as in "banana"; such matches, and long ones, are merged from the same table with that rule. Decoding reverses the
byte table. Defined results: a null text counts as empty and has no ids; ids are packed as little-endian unsigned
32-bit integers in a binary column; an empty table gives an empty one; every row is answered by itself, so repeated
rows, repeated or null keys and extra columns do not matter.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers.models import BPE

from rankloom.llm.common import binaries, kept, mapped, text_slices
from rankloom.llm.pieces import Pieces, ends_of_rows, ids_of

RANKS = "byte_bpe_multi_50k.tiktoken"
BESIDE_A_BLANK = r"^\s|\s$|\s | \s"
#: Something that stands twice and begins a third time; looked for in matches of at most SHORT bytes.
OVERLAP = regex.compile(r"(?s)(.)(.*)\1\2\1")
SHORT = 32


def byte_characters() -> list[str]:
    """The usual byte-to-character table: printable Latin-1 bytes are themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each rank; of a number that is no rank: none."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks.get(k, b"") for k in range(max(ranks) + 1)]


def joined(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join([tokens[i] for i in ids.tolist()])


class ByteBpe:
    """One vocabulary, as it is kept in a Python worker."""

    def __init__(self, path: str, pattern: str):
        self.tokens = token_bytes(path)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.characters = byte_characters()
        self.pattern = regex.compile(pattern)
        self.table = dict(enumerate(self.characters))
        names = {token: token.decode("latin-1").translate(self.table) for token in self.ranks}
        merges = []
        for token in self.tokens:
            cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
            pairs = [(self.ranks[a], self.ranks[b], a, b) for a, b in cuts if a in self.ranks and b in self.ranks]
            merges += [(names[a], names[b]) for _, _, a, b in sorted(pairs)]
        self.model = BPE(vocab={names[t]: r for t, r in self.ranks.items()}, merges=merges)
        self.whole = Pieces(self._merged, 150_000)
        self.later = Pieces(self._later, 350_000)
        self.odd = Pieces(lambda piece: self.ids(" " + piece), 10_000)
        self.first = Pieces(self.ids, 10_000)

    def ids(self, text: str) -> bytes:
        """Packed ids, pattern match by pattern match."""
        found = b""
        one = text[1:].isalpha() and (text[0] == " " or text[0].isalpha())
        for match in [text] if one else self.pattern.findall(text):
            found += self.whole[match]
        return found

    def _merged(self, match: str) -> bytes:
        """The ids of one match, by the BPE model unless places of one token may overlap."""
        raw = match.encode()
        mapped = raw.decode("latin-1").translate(self.table)
        if len(raw) > SHORT or OVERLAP.search(mapped):
            return packed(self.leftmost(raw))
        return packed([token.id for token in self.model.tokenize(mapped)])

    def leftmost(self, raw: bytes) -> list[int]:
        """Merges two neighbours at a time, those of the least rank, of equal ones the leftmost."""
        stop = list(range(1, len(raw) + 1))  # where the part that starts at a place ends; 0: none starts there
        before = list(range(-1, len(raw)))  # where the part before one starts
        heap: list[tuple[int, int, int]] = []

        def offer(start: int) -> None:
            if start >= 0 and stop[start] < len(raw):
                end = stop[stop[start]]
                rank = self.ranks.get(raw[start:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, end))

        for start in range(len(raw)):
            offer(start)
        while heap:
            _, start, end = heapq.heappop(heap)
            middle = stop[start]
            if not middle or middle >= end or stop[middle] != end:
                continue  # a part of it has been merged since
            stop[start], stop[middle] = end, 0
            before[end] = start
            offer(before[start])
            offer(start)
        found, at = [], 0
        while at < len(raw):
            found.append(self.ranks[raw[at : stop[at]]])
            at = stop[at]
        return found

    def _later(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise ValueError("white space beside a blank")
        return self.ids(" " + piece)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids end. A blank between two non-blanks always begins a match,
        so texts are cut there; one that has a blank beside other white space is cut by itself."""
        odd = pc.match_substring_regex(texts, BESIDE_A_BLANK).to_numpy(zero_copy_only=False)
        rows: list[np.ndarray] = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            try:
                ids, ends = self._by_blanks(pc.split_pattern(texts.take(pa.array(plain)), " "))
                for k, found in zip(plain, np.split(ids, ends[:-1]), strict=True):
                    rows[k] = found
            except ValueError:  # white space beyond ASCII beside a blank
                odd[:] = True
        for k in np.flatnonzero(odd):
            cut = regex.split(r"(?<=\S) (?=\S)", texts[k].as_py())
            found = self.first[cut[0]] + b"".join(map(self.odd.__getitem__, cut[1:]))
            rows[k] = np.frombuffer(found, "<u4")
        return np.concatenate(rows), np.cumsum([len(x) for x in rows])

    def _by_blanks(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = parts.offsets.to_numpy()
        offsets, values = offsets - offsets[0], parts.flatten()
        first = values.take(pa.array(offsets[:-1]))
        for x in pc.unique(first).to_pylist():
            if x and x[-1].isspace():
                raise ValueError("white space beside a blank")
        begins = np.zeros(len(values), bool)
        begins[offsets[:-1]] = True
        rest = values.filter(pa.array(~begins))
        head, head_ends = ids_of(first, self.first.__getitem__, np.dtype("<u4"))
        tail, tail_ends = ids_of(rest, self.later.__getitem__, np.dtype("<u4"))
        # put the ids of each text's first piece before those of the others
        n_head = np.diff(head_ends, prepend=0)
        rows = np.arange(len(offsets))
        end_of_rest = ends_of_rows(offsets - rows, tail_ends)
        n_rest = np.diff(end_of_rest, prepend=0)
        ends = np.cumsum(n_head + n_rest)
        out = np.empty(len(head) + len(tail), "<u4")
        is_head = np.zeros(len(out), bool)
        start = ends - n_head - n_rest
        is_head[np.repeat(start - (head_ends - n_head), n_head) + np.arange(len(head))] = True
        out[is_head], out[~is_head] = head, tail
        return out, ends

    def decode(self, ids: np.ndarray) -> bytes:
        return joined(self.tokens, ids)

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """The characters (start, end) that each token holds a byte of."""
        raw = text.encode()
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.tokens[i]) for i in ids])
        return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def token_texts(self, ids: np.ndarray) -> list[str]:
        """What each token adds to the text: a character split among tokens comes with the one that ends it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        last = len(ids) - 1
        return [decoder.decode(self.tokens[i], final=k == last) for k, i in enumerate(ids)]


def vocabulary(path: str, pattern: str) -> ByteBpe:
    return kept("byte_bpe", path, pattern, make=lambda: ByteBpe(path, pattern))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path, pattern)
    for rows in text_slices(batches, rows=1000):
        ids, ends = bpe.encode(rows.column("text"))
        columns = [rows.column("key"), binaries(ids, ends)]
        if offsets:
            spans = [
                [{"start": a, "end": b} for a, b in bpe.offsets(t, x)] if len(x) else []
                for t, x in zip(rows.column("text").to_pylist(), np.split(ids, ends[:-1]), strict=True)
            ]
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "offsets"][: len(columns)])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = token_bytes(path)
    for rows in text_slices(batches, "ids"):
        out = [joined(tokens, np.frombuffer(x, "<u4")) for x in rows.column("ids").to_pylist()]
        yield rows.append_column("decoded", pa.array(out, pa.binary()))


def _chosen(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    return docs.select(docs[key].alias("key"), docs[text].alias("text")), docs.schema[key].dataType.simpleString()


def encode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    offsets: bool = False,
) -> DataFrame:
    """(key, ids): packed token ids of each whole text; with offsets, also the characters of each token."""
    path = path or public_tokenizers.path(RANKS)
    chosen, kind = _chosen(docs, key, text)
    schema = f"key {kind}, ids binary" + ", offsets array<struct<start:int,end:int>>" * offsets
    return mapped(chosen, lambda batches: _encoded(batches, path, pattern, offsets), schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The input's columns with `decoded`: the bytes that the ids stand for (null ids: none)."""
    path = path or public_tokenizers.path(RANKS)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return mapped(encoded, lambda batches: _decoded(batches, path), f"{kinds}, decoded binary")


def round_trip(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """(key, ids, decoded): encode and then decode, in one Python step, so that a task needs one worker."""
    path = path or public_tokenizers.path(RANKS)
    chosen, kind = _chosen(docs, key, text)
    both = lambda batches: _decoded(_encoded(batches, path, pattern, False), path)
    return mapped(chosen, both, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)
