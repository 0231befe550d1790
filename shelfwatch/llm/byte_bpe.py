"""Byte-level BPE by prefix dynamic programming, and its exact inverse.

For every byte prefix of a piece there is exactly one token that can come last in the
prefix's encoding.  ``last_tokens`` stores it: the token ending at position ``i`` whose
neighbour, the stored token of the position where it starts, stays apart from it under
the merge ranks.  Walking back from the end gives the encoding.  The table of a prefix
never changes when bytes follow, so appends continue it, and an edit splits and recomputes
only from shortly before its position until the old and the new table agree again.

The result equals rank-by-rank merging of each match of the split pattern on its own.
Null texts count as empty: no ids.  Repeated rows stay repeated, an empty table gives an
empty result, other columns, whatever their names, are ignored.  Very long texts are encoded
whole; digests are taken a block of ids at a time.
"""
from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Chunks, Memo, worker_state

BLOCK = 1 << 17  # ids decoded at a time


@dataclass
class Encoded:
    """Ids of a text with what an append or an edit needs to go on from it."""

    text: str
    starts: list[int]
    pieces: list[bytes]
    tables: list[list[int]]

    def ids(self, bpe: "ByteBpe") -> list[int]:
        return [t for p, table in zip(self.pieces, self.tables) for t in bpe.walk_back(p, table)]


def _merge(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Parts after merging by rank, stopped at two parts that would merge into ``data``."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 2:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> np.ndarray:
    """For each id the two tokens its last merge joins; -1 for single bytes, -2 for tokens merging can't build."""
    out = np.full((max(ranks.values(), default=-1) + 1, 2), -2, np.int32)
    for data, i in ranks.items():
        if len(data) == 1:
            out[i] = -1
        else:
            parts = _merge(data, ranks)
            if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
                out[i] = ranks[parts[0]], ranks[parts[1]]
    return out


class Spelling:
    """Bytes of each id, one after the other in one table; gives those of many ids at once."""

    def __init__(self, of_id: dict[int, bytes]):
        size = max(of_id, default=-1) + 1
        self.length = np.zeros(size, np.int64)
        for i, data in of_id.items():
            self.length[i] = len(data)
        self.start = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(size)), np.uint8)

    def blocks(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(ids), BLOCK):
            some = ids[at:at + BLOCK]
            length = self.length[some]
            ends = np.cumsum(length)
            yield self.table[np.arange(ends[-1]) + np.repeat(self.start[some] - (ends - length), length)]


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: np.ndarray | None = None):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        merges = last_merges(ranks) if merges is None else merges
        self.head, self.tail = merges[:, 0].tolist(), merges[:, 1].tolist()
        # Tokens that merging can build; others only stand for a whole piece.
        self.built = {b: i for b, i in ranks.items() if self.head[i] != -2}
        self.longest = max(map(len, self.built), default=1)
        self.endings = ahocorasick.Automaton()  # finds every token that ends at each byte, longest first
        for b, i in self.built.items():
            self.endings.add_word(b.decode("latin-1"), (i, len(b)))
        self.endings.make_automaton()
        self.width = np.dtype("<u2" if len(self.head) <= 1 << 16 else "<u4")
        self._apart = Memo(self._stay_apart, 200_000)
        self._pieces = Memo(self._piece, 100_000)
        self._chunks = Chunks(self._direct, 400_000)
        self.spelling = Spelling(self.bytes_of)
        self.decimals = Spelling({i: b"%d," % i for i in self.bytes_of})

    def _stay_apart(self, pair: tuple[int, int]) -> bool:
        """Whether no merge crosses the border between two neighbouring tokens.

        Goes back in time: of the two tokens at the border the later one is taken apart, and
        what then touches the border must not have merged before that.  Of equal ranks the
        left one merges first.
        """
        (left, right), before = pair, len(self.head)
        while True:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if rank is not None and rank < before:
                return False
            left_whole, right_whole = self.head[left] < 0, self.head[right] < 0
            if left_whole and right_whole:
                return True
            if right_whole or not left_whole and left > right:
                before, left = left, self.tail[left]
            else:
                before, right = right + 1, self.head[right]

    def last_tokens(self, piece: bytes, table: list[int] | None = None, old: bytes = b"", old_table: list[int] | None = None) -> list[int]:
        """The last token of every prefix; ``table`` holds those already known.

        ``old`` is a piece with the same end: as soon as the table has agreed with its table
        for as long as any token reaches back, the rest is taken from there.
        """
        table = [-1] if table is None else table
        known, apart = len(table), self._apart
        first = max(0, known - self.longest)
        shift = len(old) - len(piece)
        common = 0
        if old_table is not None:
            while common < min(len(old), len(piece)) and old[-1 - common] == piece[-1 - common]:
                common += 1
        settled = len(piece) - common + self.longest if old_table is not None else len(piece) + 1
        table.extend([-1] * (len(piece) + 1 - known))
        same, at = 0, known
        for end, (here, size) in self.endings.iter(piece[first:].decode("latin-1")):
            end += first + 1
            if end > at:
                if at >= settled:
                    same = same + 1 if table[at] == old_table[at + shift] else 0
                    if same >= self.longest:
                        table[at + 1:] = old_table[at + 1 + shift:]
                        return table
                at = end
            if end >= known and table[end] < 0:
                left = end - size
                if left == 0 or apart[table[left], here]:
                    table[end] = here
        return table

    def walk_back(self, piece: bytes, table: list[int]) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, at = [], len(piece)
        while at:
            out.append(table[at])
            at -= len(self.bytes_of[table[at]])
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.walk_back(data, self.last_tokens(data)))

    def _direct(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self._pieces[piece]
        return np.array(out, self.width).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(self._chunks.encode(text), self.width)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(part.tobytes() for part in self.spelling.blocks(np.asarray(ids, np.int64)))

    def _split(self, text: str, at: int = 0) -> Iterator[tuple[int, bytes]]:
        return ((m.start(), m.group().encode()) for m in self.pattern.finditer(text, at))

    def start(self, text: str) -> Encoded:
        found = list(self._split(text))
        return Encoded(text, [s for s, _ in found], [p for _, p in found], [self.last_tokens(p) for _, p in found])

    def append(self, old: Encoded, more: str) -> Encoded:
        """Encoding of ``old.text + more``."""
        return self.edit(old, len(old.text), len(old.text), more)

    def edit(self, old: Encoded, start: int, end: int, put: str) -> Encoded:
        """Encoding after the characters start..end are replaced: only pieces near the edit are done anew.

        Splitting starts three pieces before the edit, as far as a match can look ahead, and
        stops at the first old piece behind it that begins where a new one does.
        """
        text = old.text[:start] + put + old.text[end:]
        moved = len(put) - (end - start)
        head = max(0, bisect_right(old.starts, start) - 4)
        new, tail = [], len(old.starts)
        for at, piece in self._split(text, old.starts[head] if old.starts else 0):
            if at >= start + len(put):
                k = bisect_left(old.starts, at - moved)
                if k < len(old.starts) and old.starts[k] == at - moved:
                    tail = k
                    break
            new.append((at, piece))
        near, tables = old.pieces[head:tail], []
        for k, (_, piece) in enumerate(new):
            before = near[k] if k < len(near) else b""
            same = 0
            while same < min(len(before), len(piece)) and before[same] == piece[same]:
                same += 1
            behind = len(near) - (len(new) - k)  # the old piece as far from the end of the edit
            there = head + behind
            tables.append(self.last_tokens(
                piece, old.tables[head + k][:same + 1] if same else None,
                *((old.pieces[there], old.tables[there]) if 0 <= behind else ())))
        return Encoded(text, old.starts[:head] + [at for at, _ in new] + [s + moved for s in old.starts[tail:]],
                       old.pieces[:head] + [p for _, p in new] + old.pieces[tail:], old.tables[:head] + tables + old.tables[tail:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encoder(path: str, pattern: str, merges: np.ndarray | None = None) -> ByteBpe:
    """One encoder, with its caches, per Python worker."""
    return worker_state("byte_bpe", (path, pattern), lambda: ByteBpe(read_ranks(path), pattern, merges))


def _shared_merges(docs: DataFrame, path: str):
    """The last merges of all tokens, found once and broadcast: two numbers per token."""
    return docs.sparkSession.sparkContext.broadcast(last_merges(read_ranks(path)))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    merges = _shared_merges(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern, merges.value)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = pa.array([bpe.encode(text or "").astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (bytes) of every row of ids."""
    merges = _shared_merges(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern, merges.value)
        for batch in batches:
            data = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Number and digest of the ids of every whole text, and digest of what they decode to; map-only.

    The ids leave the task only where asked for: they take more room than the texts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                       + [("ids", pa.list_(pa.int32()))] * with_ids)

    merges = _shared_merges(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern, merges.value)
        for batch in batches:
            rows, lists = [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                numbers, decoded = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), BLOCK):
                    for part in bpe.decimals.blocks(ids[at:at + BLOCK]):
                        numbers.update(part if at + BLOCK < len(ids) else part[:-1])  # no comma behind the last id
                for part in bpe.spelling.blocks(ids):
                    decoded.update(part)
                rows.append((len(ids), numbers.hexdigest(), decoded.hexdigest()))
                if with_ids:
                    lists.append(ids.astype(np.int32))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *columns] + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
