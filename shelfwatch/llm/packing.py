"""Packing documents into training sequences by first-fit decreasing.

1. Every whole text is encoded, an end id is appended and the ids are cut into pieces of
   ``CAPACITY``; only a document's last piece is shorter.  Pieces are numbered and written.
2. Pieces are dealt to groups at random (by a hash of their number), about ``GROUP`` to a
   group whatever the corpus, so a very long document is spread over groups and groups look
   alike.
3. In a group pieces go in descending length, each into the first sequence that has room
   for it.  The first is found by a tournament tree over the sequences' free room: a node
   holds the larger room of its two children, so the search goes down once and the update
   up once.  A piece is never cut again, so pieces stay as long as they can.

A sequence is padded to ``CAPACITY`` unless its length is a power of two, which trains at its own
length (``padding``).  Sequence ids are unique, not dense; offsets are gapless from 0.

Null and empty texts hold the end id alone.  Very long texts are encoded whole, their pieces
become many rows.  Rows with equal ids or texts stay apart: each has pieces of its own; null
doc_ids are kept.  Pieces of equal length are placed by their number.  An empty table gives
no pieces.  Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwatch.llm.common import Chunks, worker_state
from shelfwatch.session import cut_lineage

CAPACITY = 2_048
GROUP = 16_384
CACHED_WORDS = 800_000
LONG_WORD = 400
# The split pattern of byte-level tokenizers: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = ("It's 12 (words),  and\n\nmore\t é日本 😀  ", "  x\n\n\ny 's 'S", "\x00\x1c a b  ")


class ByteLevelEncoder:
    """Ids of whole texts, word by word where a byte-level tokenizer lets itself be cut.

    Chunks are encoded by rank, which gives what the tokenizer gives as long as its merges
    are listed in the order of their ids; that, and the pattern, is tried out when the encoder
    is made.  Other tokenizers, texts with special strings, and very long words go through
    the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = self._ranked()
        self.chunks = Chunks(self._direct, CACHED_WORDS) if self.by_rank else None

    def _ranked(self) -> tiktoken.Encoding | None:
        # Byte-level vocabularies spell visible bytes as themselves, the others from 256 on in their order.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
        byte = {chr(b): b for b in range(256) if b not in hidden} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocab = {k: i for k, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if k not in self.special}
        if any(c not in byte for k in vocab for c in k):
            return None
        ranks = {bytes(byte[c] for c in k): i for k, i in vocab.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        by_rank = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        some = sorted(vocab, key=vocab.get)[::37]
        probes = [*_PROBES, *(a + " " + b for a, b in zip(some, some[1:]))]
        same = all(by_rank.encode_ordinary(p) == self._whole(p).tolist() for p in probes)
        return by_rank if same else None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width)

    def _direct(self, text: str) -> bytes:
        if max(map(len, text.split()), default=0) > LONG_WORD:
            return self._whole(text).tobytes()
        return np.array(self.by_rank.encode_ordinary(text), self.width).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, ``width`` bytes each."""
        if self.chunks is None or any(t in text for t in self.special):
            return self._whole(text).tobytes()
        return self.chunks.encode(text)


def encoder(path: str) -> ByteLevelEncoder:
    return worker_state("packing", path, lambda: ByteLevelEncoder(path))


_PIECES = [("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64())]
_DDL = "doc_id long, piece long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece (its number), start, length, ids_crc32, doc_tokens and, where asked for, ids.

    Numbers follow the task and the order in it: write the result before it is used twice.
    """
    schema = pa.schema(_PIECES + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, lists = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(coder.encode(text or ""), coder.width), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    rows.append((doc_id, number, start, len(part), zlib.crc32(part), len(ids)))
                    number += 1
                    if with_ids:
                        lists.append(part.astype(np.int32))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _DDL + ", ids array<int>" * with_ids)


class Tournament:
    """Winner tree over the free room of sequences, all of them empty at first."""

    def __init__(self, rooms: list[int]):
        self.leaves = 1
        while self.leaves < len(rooms):
            self.leaves *= 2
        self.best = [0] * self.leaves + rooms + [0] * (self.leaves - len(rooms))
        for node in range(self.leaves - 1, 0, -1):
            self.best[node] = max(self.best[2 * node], self.best[2 * node + 1])

    def take(self, size: int) -> int:
        """The first sequence with room for ``size``, which it then has less."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            room = max(best[2 * node], best[2 * node + 1])
            if best[node] == room:
                break
            best[node] = room
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` descend and are none above ``capacity``."""
    n, full = len(lengths), int((lengths == capacity).sum())
    where, offset = np.arange(n, dtype=np.int64), np.zeros(n, np.int64)
    if n > full:
        tree = Tournament([capacity] * (n - full))
        used = [0] * (n - full)
        for k in range(full, n):
            size = int(lengths[k])
            at = tree.take(size)
            where[k], offset[k] = full + at, used[at]
            used[at] += size
    return where, offset


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, group: int = GROUP,
                   with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece and, where asked for, its ids."""
    pieces = cut_lineage(cut_documents(docs, path, end_id, capacity, with_ids))
    groups = max(1, -(-pieces.count() // group))

    def place(key, table):
        order = np.lexsort([table["piece"].to_numpy(), -table["length"].to_numpy()])
        table = table.take(pa.array(order))
        where, offset = first_fit_decreasing(table["length"].to_numpy(), capacity)
        sequence = (key[0].as_py() << 32) + where
        return table.drop_columns(["piece", "dealt"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    columns = _DDL.replace("piece long, ", "") + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return dealt.groupBy("dealt").applyInArrow(place, columns)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, tokens, padded: how full the sequences are."""
    lengths = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return lengths.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
                       F.coalesce(F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))), F.lit(0)).alias("padded"))
