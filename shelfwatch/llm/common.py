"""Table access, batch settings and shared-folder files of the corpus operators."""
from __future__ import annotations

import ctypes
import gc
import posixpath
from collections.abc import Callable
from urllib.parse import urlsplit

import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.session import tune

# Rows of one Arrow batch: texts differ by a factor of 10,000 in length, so a batch stays small.
BATCH_ROWS = 256

# A side of a join with at most so many rows, of a few numbers each, is broadcast.
SMALL = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of every job of this package."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``: those of smallest hash of ``key``.

    Only hashes meet in one task; the rows themselves are picked by a filter.
    """
    h = F.xxhash64(key)
    cut = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("cut")).first()["cut"]
    return df.filter(h <= F.lit(cut).cast("long")).limit(rows)


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if a count finds at most ``limit`` rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= limit else df


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder every executor can reach (file:, hdfs:, s3: or a plain path)."""
    if not urlsplit(uri).scheme:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def child(path: str, name: str) -> str:
    return posixpath.join(path, name)


class Memo(dict):
    """Worker cache of at most ``limit`` entries in two generations; a miss is computed by ``make``.

    When the young half is full it becomes the old one, and what is asked for again moves up
    from there, so frequent keys stay while rare ones pass through.  Keys longer than
    ``longest`` are computed each time anew, so the entries are short keys and what comes of them.
    """

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = 100):
        super().__init__()
        self.make, self.half, self.longest = make, max(1, limit // 2), longest
        self.old: dict = {}

    def __missing__(self, key):
        if key in self.old:
            value = self.old[key]
        else:
            value = self.make(key)
            if isinstance(key, (str, bytes)) and len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_state: dict[tuple[str, object], object] = {}


def worker_state(owner: str, key, make: Callable):
    """What a Python worker keeps between tasks (encoders, caches) for the operator ``owner``.

    Workers are reused by every stage of an application.  What another operator left behind is
    dropped, memory included, as soon as this one needs a place.
    """
    if (owner, key) not in _state:
        if any(o != owner for o, _ in _state):
            for other in [k for k in _state if k[0] != owner]:
                del _state[other]
            gc.collect()
            try:  # hand freed pages back to the system where the C library can
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass
        _state[owner, key] = make()
    return _state[owner, key]


def word_numbers() -> Memo:
    """Cache of 64-bit hashes of words (bytes), shared by the operators on shingles and windows."""
    return worker_state("words", None, lambda: Memo(xxhash.xxh64_intdigest, 200_000))


class _Unsafe(Exception):
    """A text whose white space reaches over more than one chunk."""


class Chunks:
    """A text's encoding as the sum of its chunks': " word", or "\\nword" behind a line break.

    For split patterns none of whose matches crosses a lone space or line break between two
    words.  ``direct`` encodes any text to bytes; a chunk's are kept, so a text is one join.
    Texts with other white space around words are encoded directly, and so is all text
    if ``direct`` does not add up on a few probes.
    """

    PROBES = ("It's 12 (words), and\nmore\n\n'S x\n y é日本 😀 !?\n", "\nab cd", " ab")

    def __init__(self, direct: Callable[[str], bytes], limit: int):
        self.direct = direct
        self.memo = Memo(self._chunk, limit)
        self.adds_up = True
        self.adds_up = all(self.encode(p) == direct(p) for p in self.PROBES)

    def _chunk(self, word: str) -> bytes:
        behind_break = word[:1] == "\0"
        body = word[1:] if behind_break else word
        if not word or body[:1].isspace() or body[-1:].isspace():
            raise _Unsafe
        return self.direct(("\n" if behind_break else " ") + body)

    def encode(self, text: str) -> bytes:
        if self.adds_up and "\0" not in text:
            marked = text.replace("\n", " \0")
            first, *words = marked.split(" ")
            # Two lone line breaks in a row may be one match with what follows.
            if " \0 \0 " not in marked and not marked.endswith(" \0 \0") and not first[:1].isspace() and not first[-1:].isspace():
                try:
                    return self.direct(first) + b"".join(map(self.memo.__getitem__, words))
                except _Unsafe:
                    pass
        return self.direct(text)
