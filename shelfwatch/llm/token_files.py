"""Token-id files: one zstandard frame per document, one shared dictionary, an offset index.

Layout of a folder in storage every executor can reach:

* ``<name>.ids``: frames of consecutive documents, each document compressed on its own
  with the shared dictionary, so that a short document is read without its neighbours;
* ``dictionary``: the dictionary's bytes, trained on serialized id arrays;
* ``index`` (Parquet): ``doc_id, part, place, file, offset, length, n_tokens, local_start``
  and the SHA-256 of the dictionary.  Part numbers ascend with doc_id, places within a
  part too.  The index lists files of finished tasks only, so what a lost or repeated
  task leaves behind is never read.

Ids are little-endian and 2 bytes wide where the vocabulary allows it, else 4.  Null
texts count as empty and hold the end id alone.  Rows with equal ids stay apart, next to
each other; null ids come first.  Very long texts are one frame each.  An empty table gives an
empty index.  Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from shelfwatch.llm.common import Memo, child, hash_sample, open_folder, worker_state

DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCS = 512
SAMPLE_PIECE = 4 * 1024
LEVEL = 3
CACHED_WORDS, CACHED_PIECES = 200_000, 400_000
INDEX_DDL = (
    "doc_id long, part int, place long, file string, offset long, length long, n_tokens long, local_start long, "
    "dictionary_sha256 string"
)
INDEX = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
    ("length", pa.int64()), ("n_tokens", pa.int64()), ("local_start", pa.int64()), ("dictionary_sha256", pa.string()),
])


# Texts of printable ASCII, precomposed Latin-1 letters and blanks need no normalisation but lower case.
PLAIN = re.compile("[ \t-\r!-~À-ÖØ-öø-ÿ]*")
PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t-\r]+")


class WordEncoder:
    """Encodes a text piece by piece for tokenizers that drop white space and never join across it.

    The ids of a piece of a plain text, or of a word of any other, are kept as bytes while they are
    cached, so a text is one join.  ``word_wise`` tells whether a tokenizer is of that kind, ``plain``
    whether its pieces are those of ``PLAIN_PIECES``; others encode whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.word_wise = self._is_word_wise()
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in (*range(33, 127), *range(0xC0, 0x100))}
        self.packed = [self._packed([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = Memo(self._piece, CACHED_PIECES)
        self.words = Memo(self._word, CACHED_WORDS)
        self.plain = self.word_wise and self._is_plain()

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_word_wise(self) -> bool:
        probe = ["Word one's 2x, (three)...", "é́ 中 1½!?"]
        return all(
            self._raw([" \t".join(p.split()) + "\n\x0b "])[0] == [i for w in p.split() for i in self._raw([w])[0]]
            for p in probe
        )

    def _is_plain(self) -> bool:
        """Whether pieces of plain texts may go straight to the tokenizer's merge model, tried on every plain character."""
        if any(self.spelling[c] != chr(c) for c in range(33, 127)):
            return False
        probe = [*map(chr, self.spelling), "Plain,", "It's", "don'T", "x1y22", "ÉÀ.ß", "a''s", "(É)", "...'ll",
                 " It's\t(x1) 'S\r\n\x0b\x0cÉ,, 'll 9.5% "]
        return all(self._by_model(w) == self._packed(ids) for w, ids in zip(probe, self._raw(probe)))

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.translate(self.spelling)
        return b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(spelt)])

    def _by_model(self, text: str) -> bytes:
        """Ids of a plain text by the merge model alone."""
        return b"".join(map(self.pieces.__getitem__, PLAIN_PIECES.findall(text.lower())))

    def _word(self, data: bytes) -> bytes:
        word = data.decode()
        if self.plain and self._may_go_plain(word):
            return self._by_model(word)
        return self._packed(self._raw([word])[0])

    @staticmethod
    def _may_go_plain(text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and "<|" not in text

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text, ``width`` bytes each."""
        if not self.word_wise:
            return self._packed(self._raw([text])[0])
        if self.plain and self._may_go_plain(text):
            return self._by_model(text)
        return b"".join(map(self.words.__getitem__, text.encode().split()))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.width)

    def serialize(self, text: str, end_id: int) -> bytes:
        """Ids of a whole text and the end id."""
        return self.encode_bytes(text) + self._packed([end_id])


def encoder(path: str) -> WordEncoder:
    return worker_state("token_files", path, lambda: WordEncoder(path))


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample: int = SAMPLE_DOCS,
                     size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the id arrays of the ``sample`` documents of smallest id hash.

    The sample bounds the one task that trains and what the driver gets (``size`` bytes
    at most).  With too little to train on, the dictionary is the arrays themselves.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pieces = encoder(path), []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = coder.serialize(text or "", end_id)
                pieces.extend(data[i:i + SAMPLE_PIECE] for i in range(0, len(data), SAMPLE_PIECE))
        try:
            data = zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            data = b"".join(pieces)[:size]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["dictionary"])

    few = hash_sample(docs, "doc_id", sample).select("text").coalesce(1)
    rows = few.mapInArrow(train, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


@dataclass(frozen=True)
class TokenFiles:
    """A written folder: where it is, its index and the width of an id."""

    folder: str
    index: DataFrame
    dictionary_sha256: str
    id_bytes: int


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the folder in ascending doc_id order.

    Texts are dealt to tasks by ranges of (doc_id, text hash); each task streams its
    documents into one file under a name of its own and returns their index rows.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    files, base = open_folder(folder)
    files.create_dir(child(base, "ids"), recursive=True)
    with files.open_output_stream(child(base, "dictionary")) as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(shared.value))
        store, root = open_folder(folder)
        name, out, offset, place, start = f"{part:06d}-{uuid.uuid4().hex}.ids", None, 0, 0, 0
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = coder.serialize(text or "", end_id)
                    frame = packer.compress(data)
                    out = out or store.open_output_stream(child(child(root, "ids"), name))
                    out.write(frame)
                    n = len(data) // coder.width.itemsize
                    rows.append((doc_id, part, place, name, offset, len(frame), n, start, digest))
                    offset, place, start = offset + len(frame), place + 1, start + n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)
        finally:
            if out:
                out.close()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = f"{folder.rstrip('/')}/index"
    dealt.mapInArrow(write, INDEX_DDL).write.parquet(at)
    return TokenFiles(folder, spark.read.schema(INDEX_DDL).parquet(at), digest, encoder(path).width.itemsize)


def with_starts(index: DataFrame) -> DataFrame:
    """Index rows with ``start``, the number of ids of all documents before.

    One total per file meets on the driver: as many as the writing job had tasks.
    """
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, base = [], 0
    for row in totals:
        bases.append((row["part"], base))
        base += row["n"]
    parts = index.sparkSession.createDataFrame(bases, "part int, base long")
    return index.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("local_start"))


def read_frames(store, path: str, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """Frames of one file; neighbours are read at once."""
    with store.open_input_file(path) as file:
        at = 0
        while at < len(spans):
            end, stop = at + 1, sum(spans[at])
            while end < len(spans) and spans[end][0] == stop:
                stop, end = sum(spans[end]), end + 1
            file.seek(spans[at][0])
            data, first = file.read(stop - spans[at][0]), spans[at][0]
            for offset, length in spans[at:end]:
                yield data[offset - first:offset - first + length]
            at = end


def read_token_files(written: TokenFiles, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, where asked for, the ids, all read back from the files.

    ``ids_crc32`` is taken over the ids as little-endian unsigned 32-bit integers.
    Raises if the dictionary, a frame or a length is not what the index says.
    """
    spark, folder, want, width = written.index.sparkSession, written.folder, written.dictionary_sha256, written.id_bytes
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.list_(pa.int32()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        with store.open_input_file(child(root, "dictionary")) as file:
            dictionary = file.read()
        if hashlib.sha256(dictionary).hexdigest() != want:
            raise ValueError("the dictionary is not the one the files were written with")
        unpacker = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        for batch in batches:
            rows = batch.to_pylist()
            out, ids = [], []
            for name, group in groupby(rows, key=itemgetter("file")):
                group = list(group)
                frames = read_frames(store, child(child(root, "ids"), name), [(r["offset"], r["length"]) for r in group])
                for row, frame in zip(group, frames):
                    found = np.frombuffer(unpacker.decompress(frame), f"<u{width}").astype("<u4")
                    if len(found) != row["n_tokens"]:
                        raise ValueError(f"document {row['doc_id']}: {len(found)} ids, not {row['n_tokens']}")
                    out.append((row["doc_id"], row["start"], len(found), zlib.crc32(found.tobytes())))
                    if with_ids:
                        ids.append(found.astype(np.int32))
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, schema=schema)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_starts(written.index).select("doc_id", "part", "place", "file", "offset", "length", "n_tokens", "start")
    dealt = rows.repartitionByRange(tasks, "part", "place").sortWithinPartitions("part", "place")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
