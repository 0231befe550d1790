"""Interaction audit of text filters: what every order of the filters removes at every step.

A document enters with one mask, the set of filters it fails.  All documents of a part with
one mask behave alike, so counts by (part, mask) stand for the corpus.  Under an order of
the filters a mask is removed at the first of its filters.  Orders that begin with the same
filters are consecutive in lexicographic (Lehmer) rank: each beginning "filters the mask
passes, then one it fails" is removed at the step of its length for one interval of ranks.
``mask_edges`` lists the ends of these intervals.  A mask's count is added where an interval
starts and subtracted behind its end; a running sum over the ranks of a part and step then
gives what is removed there.  All other figures follow from these and from the mask counts.

Four native conditions on the text (``text_failures``) and one across the table make the masks:

* A: fewer than 200 words; B: distinct words are less than half of the words;
  C: more than 3 of 100 code points are A-Z; D: the text holds one of ``#$%&*|``;
* E: a document of smaller doc_id, anywhere in the table, has the same text.

Copies are settled by digests: counts are combined per digest and attributes before the
digests meet, so a text that a third of all documents hold costs a row per task.

Words are maximal runs ``[^\\x20\\x09-\\x0D]+``, case-sensitive.  Null and empty texts are one and the
same text of no words (they fail A only, and E behind the first).  Very long texts are read
whole, by the task that scans them.  A null doc_id is nobody's smaller id and has none before
it: such rows pass E.  Rows that repeat a doc_id and text count each, and none of them makes
the others fail E.  A null ``lang`` is the part ''.  A document has label 1 if any of its label
rows says so; rows without label, or with a null one, add to no loss.  An empty table gives no
rows.  Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200
_BLANK = " \t\n\x0b\x0c\r"


def orders(filters: str = FILTERS) -> list[str]:
    """All orders by lexicographic rank."""
    return ["".join(p) for p in permutations(sorted(filters))]


def lehmer_rank(beginning: str, filters: str = FILTERS) -> int:
    """Rank of the first order that begins so."""
    left, rank = sorted(filters), 0
    for letter in beginning:
        at = left.index(letter)
        rank += at * factorial(len(left) - 1)
        del left[at]
    return rank


def mask_edges(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """mask, step, rank, sign: ends of the rank intervals in which a mask is removed at a step.

    Bit ``k`` of a mask is the ``k``-th filter.  An interval that reaches the last rank has no
    end.  A few hundred rows for five filters, whatever the data.
    """
    last, edges = factorial(len(filters)), []
    for mask in range(1, 1 << len(filters)):
        failed = [f for k, f in enumerate(filters) if mask >> k & 1]
        passed = [f for f in filters if f not in failed]
        for before in range(len(passed) + 1):
            for start in permutations(passed, before):
                for letter in failed:
                    rank = lehmer_rank("".join(start) + letter, filters)
                    end = rank + factorial(len(filters) - before - 1)
                    edges.append((mask, before + 1, rank, 1))
                    if end < last:
                        edges.append((mask, before + 1, end, -1))
    return edges


def text_failures(text: str = "text") -> list[Column]:
    """Conditions A to D of a text that is not null, given ``n_words`` and ``n_distinct``."""
    n, distinct = F.col("n_words"), F.col("n_distinct")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < MIN_WORDS, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), F.col(text).rlike("[#$%&*|]")]


def _bits(failures: list[Column]) -> Column:
    return reduce(Column.__add__, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures)])


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask (A to D) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANK))
    words = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    counted = words.withColumn("n_words", F.size("words")).withColumn("n_distinct", F.size(F.array_distinct("words")))
    return counted.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(text_failures()).alias("mask"))


def flags(labels: DataFrame) -> DataFrame:
    """labelled, good, toxic: one row per labelled document."""
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail."""
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = document_masks(docs)
    marked = rows.join(flags(labels), rows["doc_id"] == F.col("labelled"), "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) if c in ("good", "toxic") else F.col(c) for c in kind])
    # Rows of one id first, then ids of one text: n documents, of which `first.c` bear the smallest id.
    per_id = marked.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("c"))
    known = F.col("doc_id").isNotNull()
    per_text = per_id.groupBy(*kind).agg(
        F.sum("c").alias("n"), F.sum(F.when(known, F.col("c")).otherwise(0)).alias("n_known"),
        F.min(F.when(known, F.struct("doc_id", "c"))).alias("first"))
    lowest = per_text.withColumn("lowest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    fresh = F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.c")).otherwise(0)
    copies = F.col("n_known") - fresh
    both = lowest.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), (F.col("n") - copies).alias("n")),
        F.struct(F.col("mask").bitwiseOR(16).alias("mask"), copies.alias("n")))).alias("m"))
    return both.select("part", "m.mask", F.col("m.n").alias("n"), (F.col("m.n") * F.col("good")).alias("good"),
                       (F.col("m.n") * F.col("toxic")).alias("toxic")).groupBy("part", "mask").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report over every part, order and step from counts by part and mask.

    ``counts``: part, mask, n, good, toxic (none of them null).  Work and rows depend on the
    number of parts alone.
    """
    spark: SparkSession = counts.sparkSession
    edges = spark.createDataFrame(mask_edges(filters), "mask int, step int, rank int, sign int")
    ranks = orders(filters)
    letters = spark.createDataFrame(
        [(r, o, s + 1, o[s], filters.index(o[s])) for r, o in enumerate(ranks) for s in range(len(filters))],
        "rank int, filter_order string, step int, letter string, bit int")
    sums = ["n", "good", "toxic"]
    ends = counts.filter("mask > 0").join(F.broadcast(edges), "mask").groupBy("part", "step", "rank").agg(
        *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in sums])
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)) for k in range(len(filters))]).alias("failing"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(filters))]).alias("alone"))
    grid = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ranks) - 1))).alias("rank")).join(F.broadcast(letters), "rank")
    by_rank = Window.partitionBy("part", "step").orderBy("rank")
    removed = grid.join(ends, ["part", "step", "rank"], "left").select(
        *grid.columns, *[F.sum(F.coalesce(c, F.lit(0))).over(by_rank).alias(f"{c}_here") for c in sums])
    so_far = F.sum("n_here").over(Window.partitionBy("part", "rank").orderBy("step"))
    return removed.select(
        "part", "filter_order", "step", (F.col("total") - so_far).alias("kept"), F.col("n_here").alias("removed"),
        (F.get("failing", "bit") - F.col("n_here")).alias("redundant"), F.get("alone", "bit").alias("unique_fails"),
        F.col("good_here").alias("good_lost"), F.col("toxic_here").alias("toxic_lost"),
        F.sum("n_here").over(Window.partitionBy("part", "letter")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole texts of ``docs``."""
    return audit(mask_counts(docs, labels))
