"""Near-duplicate texts by ProbMinHash, banding and verification.

Words are runs without white space, A-Z lower-cased; five in a row are a shingle, and a text of fewer words
is one shingle.  A shingle's weight is ``1 + log2(count)``, so a line repeated a hundred times counts more
than once but not a hundredfold.  Every shingle starts a Poisson process with its weight as the rate; each arrival goes
to a random register, which keeps the earliest.  A shingle stops as soon as its next arrival cannot change
any register of its text.  Two registers agree with the probability Jaccard similarity of the weights.
Where shingles repeat, that can be far below the similarity that confirms a link, so such a text also has
registers with the weight one for every shingle; they agree with the Jaccard similarity of the sets.

Equal texts form one class from the start and only one of them goes on.  Registers are hashed
in bands; texts that share a band are candidates.  In every band bucket all are first compared with its
centre, so a bucket of n texts makes n rows.  Confirmed links join classes.  Where a bucket still holds
texts of different classes, all similar pairs across these classes are found by a prefix join of their
shingles, so that no link in any bucket is lost, whatever its size.  A link is confirmed by the exact Jaccard similarity of the
shingle sets, read from the texts again.  A class is a connected component of links.

Defined cases: null, empty and blank texts have no shingle and are classes of their own; a text of any
length is used whole; repeated rows and ids are members of the same class; the class id is the smallest id
in it (null only if all its ids are null); an empty table gives no rows; input columns keep their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditloom.llm.common import fresh, map_arrow, mix, pieces
from auditloom.plans.lineage import Scratch, cut

SHINGLE = 5
SIMILAR = 0.8
#: 25 bands of 5 registers: a pair with similarity 0.8 of its shingle sets shares a band with probability 0.99995.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
PIECE = 1 << 21
#: Slots of the filter before texts move: a bound on what is broadcast, not on what is found.
NARROW, PACK = 1 << 20, 1 << 12
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWERS = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.ones(_POWERS + 1, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(_POWERS, base, np.uint64))
    return out


_UP = _powers(_BASE)
_UNIT = _powers(pow(_BASE, -1, 1 << 64))


def _power(table: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Powers for any exponent, from a table of the first ones and one of their multiples."""
    far = n >> 16
    big = np.ones(int(far.max(initial=0)) + 1, np.uint64)
    with np.errstate(over="ignore"):
        big[1:] = np.cumprod(np.full(len(big) - 1, table[_POWERS], np.uint64))
        return table[n & _POWERS - 1] * big[far]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (hash) of all texts, ordered by text and hash; the text of each; its count."""
    data = b" ".join([*texts, b""]).translate(FOLD)
    raw = np.frombuffer(data, np.uint8)
    inside = np.r_[False, raw != 32, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    none = np.zeros(0, np.int64)
    if not len(start):
        return none.astype(np.uint64), none, none
    # A word's hash is the sum of its bytes' values times powers of a base, taken from running sums.
    run = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * _power(_UP, np.arange(len(raw))))]
    word = mix((run[end] - run[start]) * _power(_UNIT, start))
    limits = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.searchsorted(limits, start, "right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    # Every position starts a shingle but the last four of a text; a short text has one, at its first word.
    left = n[doc] - (np.arange(len(doc)) - first[doc])
    lead = (left >= SHINGLE) | ((n[doc] < SHINGLE) & (left == n[doc]))
    at = np.flatnonzero(lead)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        ok = left[at] > k
        h = np.where(ok, mix(h * np.uint64(3) + word[np.minimum(at + k, len(word) - 1)]), h)
    doc = doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return h[new], doc[new], np.diff(np.r_[new, len(h)])


def registers(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """For each text and register the shingle that arrives there first, as 32 bits of its hash."""
    weight = 1 + np.log2(count)
    when = np.full(n_docs * REGISTERS, np.inf)
    who = np.zeros(n_docs * REGISTERS, np.uint64)
    time = np.zeros(len(h))
    state = h.copy()
    live = np.arange(len(h))
    while len(live):
        state[live] = s = mix(state[live] + np.uint64(0x9E3779B97F4A7C15))
        u = ((s >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[live] += -np.log(u) / weight[live]
        slot = doc[live] * REGISTERS + (mix(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS)).astype(np.int64)
        t = time[live]
        before = when[slot]
        better = t < before
        slot, t, i = slot[better], t[better], live[better]
        np.minimum.at(when, slot, t)
        won = when[slot] == t
        who[slot[won]] = h[i[won]]
        worst = when.reshape(n_docs, REGISTERS).max(1)
        live = live[time[live] < worst[doc[live]]]
    return (who >> np.uint64(32)).astype(np.uint32).reshape(n_docs, REGISTERS)


def bands(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """Hashes of each text's bands."""
    reg = registers(h, doc, count, n_docs).reshape(n_docs, BANDS, ROWS).astype(np.uint64)
    band = np.zeros((n_docs, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        band = mix(band ^ (reg[:, :, k] + np.uint64(k)))
    return band.view(np.int64)


def all_bands(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int) -> list[np.ndarray | None]:
    """Each text's bands with weights and with unit weights, which are the same where no shingle repeats; None without shingles."""
    full = np.bincount(doc, minlength=n_docs) > 0
    out = [x if f else None for x, f in zip(bands(h, doc, count, n_docs), full)]
    again = np.bincount(doc[count > 1], minlength=n_docs) > 0
    mine = again[doc]
    which = np.flatnonzero(again)
    for k, x in zip(which.tolist(), bands(h[mine], np.searchsorted(which, doc[mine]), np.ones(int(mine.sum()), np.int64), len(which))):
        out[k] = np.unique(np.r_[out[k], x])
    return out


def signed(df: DataFrame, ids: str, text: str) -> DataFrame:
    """``ids``, ``key`` of the text (null without words) and ``bands`` (hashes) of every row."""
    kind = df.schema[ids].dataType.simpleString()

    def run(batches):
        for b in batches:
            for p in pieces(b, text, PIECE):
                texts = [t or b"" for t in p.column(text).cast(pa.binary()).to_pylist()]
                h, doc, count = shingles(texts)
                yield pa.RecordBatch.from_arrays(
                    [p.column(ids), p.column("key"), pa.array(all_bands(h, doc, count, len(texts)), pa.list_(pa.int64()))], names=[ids, "key", "bands"])

    keyed = df.select(F.col(ids), F.col(text), text_key(F.col(text)).alias("key"))
    return map_arrow(keyed, run, f"`{ids}` {kind}, key binary, bands array<long>")


def text_key(text: Column) -> Column:
    """128 bits of a text; null for a text without any word."""
    return F.when(text.rlike("[^ \\t-\\r]"), F.unhex(F.md5(text)))


def confirmed(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """``edges`` (a, b) with their exact similarity.  ``texts``: key and text, one row per key."""
    a = edges.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for rb in batches:
            for p in pieces(rb, "text_a", PIECE):
                # Texts that come again and again, as that of a bucket's centre, are taken apart once.
                sides = [p.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b")]
                number: dict[bytes, int] = {}
                x, y = ([number.setdefault(t, len(number)) for t in side] for side in sides)
                h, doc, _ = shingles(list(number))
                cuts = np.searchsorted(doc, np.arange(len(number) + 1))
                sets = [h[i:j] for i, j in zip(cuts, cuts[1:])]
                same = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)]
                of = [s / max(1, len(sets[i]) + len(sets[j]) - s) for s, i, j in zip(same, x, y)]
                yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), pa.array(of, pa.float64())], names=["a", "b", "similarity"])

    return map_arrow(both.select("a", "b", "text_a", "text_b"), run, "a binary, b binary, similarity double")


def possible(texts: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of texts with different roots that may be similar: all that are, and few others.

    ``texts``: key, root, text.  Shingles are put in one order for all texts, the rarer first.  Of two similar
    texts, the first shingle they have in common stands so early in both that enough can follow; so only the early
    part of each text is joined, and only where enough can follow.  The order uses counts in ``NARROW`` slots;
    any order gives all similar pairs.
    """
    slots = np.uint64(NARROW)

    def count(batches):
        total = np.zeros(NARROW, np.int64)
        for b in batches:
            for p in pieces(b, "text", PIECE):
                total += np.bincount((shingles(p.column("text").cast(pa.binary()).to_pylist())[0] % slots).astype(np.int64), minlength=NARROW)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["slot", "n"])

    def packed(batches):
        for b in batches:
            out = []
            for slot, n in zip(b.column("slot").to_pylist(), b.column("n").to_pylist()):
                row = np.zeros(PACK, np.uint8)
                row[np.array(slot) % PACK] = np.minimum(255, 1 + 12 * np.log2(np.array(n)))
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(out, pa.binary())], names=["at", "counts"])

    # One byte per slot reaches the driver: the count on a log scale.
    found = (map_arrow(texts.select("text"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
             .groupBy(F.expr(f"slot div {PACK}").alias("at")).agg(F.collect_list("slot").alias("slot"), F.collect_list("n").alias("n")))
    often = np.zeros(NARROW, np.uint8)
    for r in map_arrow(found, packed, "at long, counts binary").collect():
        often[r["at"] * PACK:(r["at"] + 1) * PACK] = np.frombuffer(r["counts"], np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def early(batches):
        for b in batches:
            for p in pieces(b, "text", PIECE):
                h, doc, _ = shingles(p.column("text").cast(pa.binary()).to_pylist())
                order = np.lexsort((h, sent.value[(h % slots).astype(np.int64)], doc))
                h, doc = h[order], doc[order]
                size = np.bincount(doc, minlength=p.num_rows)
                at = np.arange(len(h)) - (np.cumsum(size) - size)[doc]
                keep = size[doc] - at >= similar * size[doc] - 1e-9
                row = pa.array(doc[keep])
                yield pa.RecordBatch.from_arrays(
                    [p.column("key").take(row), p.column("root").take(row), pa.array(h[keep].view(np.int64)), pa.array((size[doc] - at)[keep].astype(np.int32)),
                     pa.array(size[doc][keep].astype(np.int32))], names=["key", "root", "h", "rest", "size"])

    part = map_arrow(texts.select("key", "root", "text"), early, "key binary, root binary, h long, rest int, size int")
    x, y = (part.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "root", "rest", "size")]) for side in "ab")
    enough = F.least("rest_a", "rest_b") >= similar / (1 + similar) * (F.col("size_a") + F.col("size_b")) - 1e-9
    return (x.join(y, "h").where((F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & enough)
            .select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct())


def components(links: DataFrame, cut) -> DataFrame:
    """``key``, ``root``: smallest key of each component, for keys that have a link.

    Rounds of linking to the smallest neighbour, larger neighbours first, then smaller ones, until nothing changes.
    """
    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
            return both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
        low = e.groupBy("b").agg(F.min("a").alias("low"))
        rest = e.join(low, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
        return low.select(F.col("low").alias("a"), "b").union(rest).distinct()

    state = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while before[0]:
        edges = cut(star(star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("key"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def classes(df: DataFrame, ids: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``key``, ``id`` (the smallest), ``root``, ``class_id`` of each distinct text that has words: its class and that class's smallest id."""
    with Scratch(df.sparkSession) as own:
        base = df.select(F.col(ids).alias("id"), F.col(text).alias("text"))
        texts = own.cut(
            signed(base, "id", "text").where(F.col("key").isNotNull())
            .groupBy("key").agg(F.min("id").alias("id"), F.min("bands").alias("bands")))
        rows = texts.select("key", F.explode("bands").alias("band"))
        many = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = own.cut(rows.join(many, "band"))
        # A bucket's centre is the text that meets most others in all its buckets: most likely what they were copied from.
        meets = shared.groupBy("key").agg(F.sum("n").alias("meets"))
        centre = shared.select("band", "key").join(meets, "key").groupBy("band").agg(F.max(F.struct("meets", "key")).alias("c"))
        shared = own.cut(shared.select("band", "key").join(centre, "band").select("band", F.col("c.key").alias("a"), "key"))
        stars = own.cut(shared.where("a <> key").select("a", F.col("key").alias("b")).distinct())
        ends = stars.select(F.col("a").alias("key")).union(stars.select(F.col("b").alias("key"))).distinct()
        # Texts without a candidate stay where they are: at most NARROW slots say which slots hold an end.
        slot = F.pmod(F.xxhash64("key"), F.lit(NARROW)).alias("slot")
        narrow = F.broadcast(ends.select(slot).distinct())
        whole = own.cut(base.select(text_key(F.col("text")).alias("key"), "text").where(F.col("key").isNotNull())
                    .withColumn("slot", slot).join(narrow, "slot", "left_semi")
                    .groupBy("key").agg(F.min("text").alias("text")).join(ends, "key", "left_semi"))
        first = own.cut(confirmed(stars, whole))
        links = first.where(F.col("similarity") >= similar).select("a", "b")
        joined = own.cut(components(links, own.cut))
        # Buckets that still hold several classes: pairs across classes, found by what similar texts must have in common.
        placed = shared.select("band", "key").join(joined, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
        mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
        open_ = own.cut(placed.join(mixed, "band").select("key", "root").distinct())
        pairs, n = own.cut_counted(possible(whole.join(open_, "key"), similar))
        if n:
            more = confirmed(pairs, whole).where(F.col("similarity") >= similar).select("a", "b")
            joined = components(links.union(more), own.cut)
        member = texts.select("key", "id").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
        small = member.groupBy("root").agg(F.min("id").alias("class_id"))
        return cut(member.join(small, "root").select("key", "id", "root", "class_id"))


def with_class(df: DataFrame, keep: list[str], ids: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> tuple[DataFrame, str]:
    """Columns ``keep`` of each row with its class id (its own id for texts without words), and that column's name."""
    key, cls = fresh(df.columns, "key", "class_id")
    found = classes(df, ids, text, similar).select(F.col("key").alias(key), F.col("class_id").alias(cls))
    rows = df.withColumn(key, text_key(F.col(text))).select(*dict.fromkeys([*keep, ids]), key)
    out = rows.join(found, key, "left").withColumn(cls, F.when(F.col(key).isNull(), F.col(ids)).otherwise(F.col(cls)))
    return out.select(*keep, cls), cls


def keep_one(df: DataFrame, ids: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each class, that with the smallest id, ties by the text's key and then the whole row; rows without words all stay."""
    key, at = fresh(df.columns, "key", "at")
    place = lambda k, i: F.unhex(F.md5(F.concat(k, F.coalesce(i.cast("string"), F.lit("-")).cast("binary"))))
    best = (classes(df, ids, text, similar).where(F.col("id").eqNullSafe(F.col("class_id")))
            .groupBy("root").agg(F.min(F.struct("key", "id")).alias("x")).select(place(F.col("x.key"), F.col("x.id")).alias(at)))
    rows = df.withColumn(key, text_key(F.col(text)))
    # Repeated rows collapse inside the tasks that read them; what is left meets the survivors where it lies.
    once = (rows.where(F.col(key).isNotNull()).groupBy(place(F.col(key), F.col(ids)).alias(at))
            .agg(F.min(F.struct(*[F.col(c) for c in df.columns])).alias("row")))
    kept = once.join(best, at, "left_semi").select("row.*")
    return kept.unionByName(rows.where(F.col(key).isNull()).drop(key))
