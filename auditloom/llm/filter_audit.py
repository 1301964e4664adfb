"""What each of five filters removes in every order of application, with duplicates found in radix text tries.

A row's failed filters are five bits.  Four of them (few words, few distinct words, capitals, symbols) are seen in
the row itself.  The fifth, a text that a row with a smaller id has too, needs the whole table: tasks insert their texts
into compressed tries, whose terminals keep the smallest id, so any number of copies leaves a task as one text; the texts
are then range-partitioned by a prefix and inserted into the tries of their range.  The prefix is adaptive: where texts of more than
1/``SHARE`` of all bytes, or of more than ``BUCKET``, share it, a prefix eight times as long divides them, and so on.  A range's tries are
emptied when a prefix ends, so that memory is bounded by a prefix, not by a partition.  The traversal returns (smallest id,
key) of each text; a row without such a partner is a duplicate.  Only ids, keys and bits meet the labels; they are reduced to counts
per part and bits, and 120 orders of five steps are read off these counts.

What reaches the driver are the digests of such prefixes; ``BUCKET`` grows with the table so that there are
fewer than 2^20 a level.

Defined cases: a null text is empty and has no words; an empty text fails few words and, if a smaller id is empty too,
the duplicate filter; a text of any length is used whole; rows with equal id and text are no duplicates of each other; a null id
is neither smaller than another nor has one smaller; a null part is the empty string; labels of a null id are not used; repeated labels count once, a mark
if any of them has it; an empty table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from auditloom.llm.common import map_arrow, pieces
from auditloom.llm.tries import RadixTrie
from auditloom.plans.lineage import cut

FILTERS = "ABCDE"
#: Fixed values of the conditions.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT, SYMBOLS = 200, 50, 3, re.compile(b"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
DUPLICATE = 1 << FILTERS.index("E")
#: First prefix, and the factor by which it grows where it does not divide the texts enough.
PREFIX, LONGER = 8, 8
#: Bytes of text that may share a prefix, and as a share of all; bytes of a task's texts in one trie; prefixes that may be too common in a level.
BUCKET, SHARE, TRIE, MANY = 1 << 25, 256, 1 << 23, 1 << 20


def failed(text: str) -> int:
    """Bits of the filters that a text fails by itself."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words))
            + 4 * (100 * capitals > MAX_CAPITAL_PCT * len(text)) + 8 * (SYMBOLS.search(raw) is not None))


def masks(docs: DataFrame, ids: str, text: str, part: str) -> DataFrame:
    """``id``, ``part``, ``key`` of the text and the bits of A to D, with the number of such rows."""
    kind = docs.schema[ids].dataType.simpleString()

    def run(batches):
        for b in batches:
            for p in pieces(b, "text"):
                texts = [t or "" for t in p.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [p.column("id"), p.column("part"), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                     pa.array([failed(t) for t in texts], pa.int32())], names=["id", "part", "key", "mask"])

    rows = docs.select(F.col(ids).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return (map_arrow(rows, run, f"id {kind}, part string, key binary, mask int")
            .groupBy("id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n")))


def _prefix(length: int) -> Column:
    return F.substring("text", 1, length)


def crowded(texts: DataFrame, bucket: int = BUCKET) -> list[tuple[int, set[str]]]:
    """(length, digests) of the prefixes that too many bytes of text share, level by level."""
    levels, length, rows = [], PREFIX, texts
    weight = F.sum(F.octet_length("text") + 1).alias("w")
    while True:
        sizes = cut(rows.groupBy(F.md5(_prefix(length)).alias("at")).agg(weight))
        if not levels:
            total = sizes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
            bucket = max(min(bucket, total // SHARE), total // MANY)
        heavy = sizes.where(F.col("w") > bucket).select("at")
        found = {r["at"] for r in heavy.collect()}
        if not found:
            return levels
        levels.append((length, found))
        # Fewer than MANY digests, whatever the size of the table.
        rows = (rows.where(F.octet_length("text") > length).withColumn("at", F.md5(_prefix(length)))
                .join(F.broadcast(heavy), "at", "left_semi").select("text"))
        length *= LONGER


def smallest(docs: DataFrame, ids: str, text: str, bucket: int = BUCKET) -> DataFrame:
    """``id``, ``key``: the smallest id of every distinct text that has an id."""
    kind = docs.schema[ids].dataType.simpleString()
    texts = docs.select(F.col(ids).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    levels = crowded(texts, bucket)

    def address(t: bytes) -> bytes:
        length = PREFIX
        for at, heavy in levels:
            if hashlib.md5(t[:at]).hexdigest() not in heavy:
                break
            length = at * LONGER
        return t[:length]

    def table(trie: RadixTrie) -> list[tuple]:
        return [(t, i) for t, i in trie.terminals() if i is not None]

    def gather(batches):
        """Distinct texts of the task, a trie at a time, with the prefix that tells their range."""
        trie, id_type = RadixTrie(), None

        def out():
            rows = table(trie)
            for k in range(0, len(rows), 512):
                some = rows[k:k + 512]
                yield pa.RecordBatch.from_arrays([pa.array([address(t) for t, _ in some], pa.binary()), pa.array([t for t, _ in some], pa.binary()),
                                                  pa.array([i for _, i in some], id_type)], names=["at", "text", "id"])
        for b in batches:
            id_type = b.column("id").type
            for p in pieces(b, "text"):
                for i, t in zip(p.column("id").to_pylist(), p.column("text").to_pylist()):
                    trie.insert(t, i)
                if trie.size > TRIE:
                    yield from out()
                    trie = RadixTrie()
        if id_type is not None:
            yield from out()

    def settle(batches):
        """A range's texts in order of prefix; a trie never ends inside a prefix."""
        trie, last, id_type = RadixTrie(), None, None

        def out():
            rows = table(trie)
            return pa.RecordBatch.from_arrays([pa.array([i for _, i in rows], id_type), pa.array([xxhash.xxh3_128_digest(t) for t, _ in rows], pa.binary())],
                                              names=["id", "key"])
        for b in batches:
            id_type = b.column("id").type
            for at, t, i in zip(*(b.column(c).to_pylist() for c in ("at", "text", "id"))):
                if at != last and trie.size > TRIE:
                    yield out()
                    trie = RadixTrie()
                last = at
                trie.insert(t, i)
        if id_type is not None:
            yield out()

    ranged = map_arrow(texts, gather, f"at binary, text binary, id {kind}").repartitionByRange("at").sortWithinPartitions("at")
    return map_arrow(ranged, settle, f"id {kind}, key binary")


def effects() -> list[tuple]:
    """What every order and step does to rows with given bits: (mask, order, step, kept, removed, redundant, alone, shares).

    ``shares``: in how many of all orders the step's filter is the first to remove such a row.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows = []
    for mask in range(1 << len(FILTERS)):
        fails = bin(mask).count("1")
        for order in orders:
            for step, f in enumerate(order):
                before = sum(bit[x] for x in order[:step])
                hit, gone = bool(mask & bit[f]), bool(mask & before)
                rows.append((mask, order, step + 1, int(not gone and not hit), int(hit and not gone), int(hit and gone), int(mask == bit[f]),
                             len(orders) // fails if hit else 0))
    return rows


def audit(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", part: str = "lang", bucket: int = BUCKET) -> DataFrame:
    """Counts of every part, order and step.  ``labels``: the id, ``quality`` and ``toxic``."""
    spark = docs.sparkSession
    marks = labels.groupBy(F.col(ids).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    first = smallest(docs, ids, text, bucket).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    rows = (masks(docs, ids, text, part).join(first, ["id", "key"], "left").join(marks, "id", "left")
            .withColumn("mask", F.col("mask") + F.when(again, DUPLICATE).otherwise(0)))
    count = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    steps = spark.createDataFrame(effects(), "mask int, filter_order string, step int, kept long, removed long, redundant long, alone long, shares long")
    total = lambda of, c="n": F.sum(F.col(of) * F.col(c))
    return count.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("alone").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), total("shares").alias("shapley"))
