"""Cross-entropy difference of a target and a background language model.

Both models are word bigrams over the whole vocabulary, so what is gathered grows with the corpus.  A bigram of two of the
``WORDS`` most frequent words is a cell of one table, which every task has; all others are counted where they meet.
That is where a count is kept, not what is counted: the probabilities are the same for any ``WORDS``.
The background model counts all documents, the target model those marked as such; both use the same smoothing: the unigram
distribution with the weight of ``PRIOR`` words.  A document's score is the mean over its words of target minus background
log probability.

Most n-grams occur once, so a table of them is as large as the texts.  None is written: each occurrence of a rare word moves
once, as the word, the one before, the one after and its document, in arrays by ranges of words (:func:`_sent`).  All
occurrences of a rare word meet in one range, so every count it needs is there (its bigrams, its own, its share as the word
before); as it has less than one in ``WORDS`` of all words, no range is hot.  What a range adds to a document goes back as one
pair of sums.  Documents that are counted and scored move once for both; others are scored by the same way, counting nothing.

Texts are not moved to be marked, except the few whose id two bit filters leave open.

Words are known by 64 bits of a hash.  Defined cases: null, empty and blank texts have no word and score 0; documents without
an id are never target; without a target document both models are the background's and every score is 0; n-grams that the
models have not seen have the smoothing's probability; texts of any length are read whole; repeated rows count and are scored
each for itself; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, functions as F

from auditloom.llm.common import bit_filter, fresh, map_arrow, pieces
from auditloom.plans.skew import parts_of

#: Symbols of the table: start of a text, any rare word, the frequent words.  The unigram distribution adds one for each of at least so many words.
VOCABULARY, PRIOR = 2048, 50.0
START, RARE = 0, 1
WORDS = VOCABULARY - 2
PIECE, PACK = 1 << 20, 1 << 12
#: Occurrences of rare words that a task holds before it sends them, and about how many meet in a range of words.
HOLD, RANGE = 1 << 19, 1 << 19
#: Documents of a task that are sent together at most, and those whose sums meet again.
SPAN, HOME = 1 << 16, 1 << 14
#: How a document takes part: counted by the background, by both models; added if it is scored.
COUNTED, TARGET, SCORED = 1, 2, 4


class Marks(NamedTuple):
    """Ids of the target documents, each once, a test that they all pass, and one that no others do."""

    ids: DataFrame
    near: Column
    sure: Column


class Model(NamedTuple):
    """Frequent words, log probabilities of their table, what smoothing needs, and the documents that are counted."""

    known: dict[bytes, int]
    target: np.ndarray
    background: np.ndarray
    #: Of each model: probabilities of the table's symbols, that of a word without a count.
    word: np.ndarray
    unseen: tuple[float, float]
    #: Occurrences of rare words; whether there is a target document.
    n_rare: int
    any_target: bool
    docs: DataFrame
    marks: Marks
    ids: str
    text: str


def vocabulary(docs: DataFrame, text: str) -> tuple[dict[bytes, int], int, int]:
    """The most frequent words and their symbols, ties in order of the words; the number of all distinct words; how often rare ones occur."""
    seen = Observation()
    top = (docs.select(F.explode(F.array_remove(F.split(F.col(text), "[ \\t-\\r]+"), "")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
           .observe(seen, F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).orderBy(F.desc("n"), "w").limit(WORDS).collect())
    return {r["w"].encode(): RARE + 1 + k for k, r in enumerate(top)}, seen.get["words"], seen.get["all"] - sum(r["n"] for r in top)


def rare(w: bytes) -> int:
    """Symbol of a word outside the table, apart from all symbols in it and their negatives."""
    h = int.from_bytes(blake2b(w, digest_size=8).digest(), "little", signed=True)
    return h if abs(h) >= VOCABULARY else h + 2 * VOCABULARY


class Coder:
    """Symbols of words, with a bounded memory for rare ones."""

    def __init__(self, known: dict[bytes, int]):
        self.known, self.seen = known, {}

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Table cells of all texts in a row, one per word, and how many each has; where rare words are, and of each the word, the one before and after.

        Before the first word is ``START``; after the last too.  The word after is a symbol of the table.
        """
        split = [t.split() for t in texts]
        if len(self.seen) > 300_000:
            self.seen = {}
        if not self.seen:
            self.seen = dict(self.known)
        flat = [w for s in split for w in s]
        for w in set(flat).difference(self.seen):
            self.seen[w] = rare(w)
        n = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))
        before = np.empty_like(word)
        before[1:] = word[:-1]
        ends = np.cumsum(n)
        before[(ends - n)[n > 0]] = START
        ids, ids_before = (np.where((x >= 0) & (x < VOCABULARY), x, RARE) for x in (word, before))
        after = np.empty_like(ids)
        after[:-1] = ids[1:]
        after[ends[n > 0] - 1] = START
        here = np.flatnonzero(ids == RARE)
        return ids_before * VOCABULARY + ids, n, here, word[here], before[here], after[here]

    def cells(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first two of :meth:`codes`; rare words are not told apart."""
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((self.known.get(w, RARE) for s in split for w in s), np.int64, int(n.sum()))
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[(np.cumsum(n) - n)[n > 0]] = START
        return before * VOCABULARY + ids, n


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def counts(docs: DataFrame, text: str, target: str, known: dict[bytes, int]) -> np.ndarray:
    """Tables of the target and of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        coder, total = Coder(sent.value), np.zeros((2, VOCABULARY**2), np.int64)
        for b in batches:
            for p in pieces(b, text, PIECE):
                code, n = coder.cells([t or b"" for t in p.column(text).cast(pa.binary()).to_pylist()])
                np.add.at(total[1], code, 1)
                np.add.at(total[0], code[np.repeat(np.asarray(p.column(target).to_pylist(), bool), n)], 1)
        there = np.flatnonzero(total[1])
        at = np.unique(there // PACK)
        ends = np.r_[np.searchsorted(there, at * PACK), len(there)]
        yield pa.RecordBatch.from_arrays([pa.array(at), _lists((there % PACK).astype(np.int16), ends), *(_lists(x[there], ends) for x in total)], names=["at", "code", "t", "b"])

    def added(rows):
        out, code = np.zeros((2, PACK)), rows.column("code").combine_chunks().flatten().to_numpy()
        for x, m in zip(out, "tb"):
            np.add.at(x, code, rows.column(m).combine_chunks().flatten().to_numpy())
        return pa.table({"at": rows.column("at")[:1], "row": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((2, VOCABULARY**2))
    rows = map_arrow(docs.select(text, target), run, "at long, code array<smallint>, t array<long>, b array<long>")
    for r in rows.groupBy("at").applyInArrow(added, "at long, row binary").toLocalIterator():
        out[:, r["at"] * PACK:(r["at"] + 1) * PACK] = np.frombuffer(r["row"]).reshape(2, PACK)
    return out.reshape(2, VOCABULARY, VOCABULARY)


def log_probabilities(table: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a word given the one before it, by table cell; probability of each symbol; that of a word without a count.

    What rare words have of it is left to :func:`_met`: a rare word's numerator, and all after a rare word.
    """
    size = table.sum() + max(VOCABULARY, n_words)
    word = (table.sum(0) + 1) / size
    given = table.sum(1)
    out = np.empty(table.shape, np.float32)
    for k in range(VOCABULARY):
        above = np.log(table[k] + PRIOR * word)
        above[RARE] = 0
        out[k] = above - np.log(given[k] + PRIOR)
    out[RARE] = 0
    return out.ravel(), word, 1 / size


def _passing(keys: DataFrame) -> Callable[[Column], Column]:
    """Whether the hash of an id may be among ``key``, by a bit filter: of others one in sixteen is.  The filter is a subquery, so no Python runs for it."""
    bits = bit_filter(keys, keys.count())
    value = keys.sparkSession.createDataFrame([(bytearray(bits.tobytes()),)], "bits binary").scalar()

    def test(key: Column) -> Column:
        slot = key.bitwiseAND(F.lit(8 * len(bits) - 1))
        byte = F.conv(F.hex(F.substring(value, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (7 - slot % 8).cast("int")) == 1

    return test


def marks(docs: DataFrame, chosen: DataFrame, ids: str) -> Marks:
    """Two filters: of the target's ids, and of the documents' ids that pass the first though they are not target.  What passes the second is left to a join."""
    one = chosen.select(ids).where(F.col(ids).isNotNull()).distinct()
    known, key = F.col(ids).isNotNull(), F.xxhash64(ids)
    if one.schema[ids].dataType != docs.schema[ids].dataType:
        return Marks(one, known, F.lit(False))  # equal after a cast, but not by hash
    near = known & _passing(one.select(key.alias("key")))(key)
    wrong = docs.select(ids).where(near).join(one, ids, "left_anti").select(key.alias("key")).distinct()
    return Marks(one, near, near & ~_passing(wrong)(key))


def mark_target(docs: DataFrame, found: Marks, keep: list[str], ids: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a flag for the target; texts do not move, except of ids that the filters leave open, and rows without an id do not meet in one task."""
    (flag,) = fresh(docs.columns, "target")
    rows = docs.select(*dict.fromkeys([*keep, ids, text]))
    joined = rows.where(found.near & ~found.sure).join(found.ids.withColumn(flag, F.lit(True)), ids, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return joined.unionByName(rows.where(found.sure | ~found.near).withColumn(flag, found.sure)), flag


def fit(docs: DataFrame, chosen: DataFrame, ids: str = "doc_id", text: str = "text") -> Model:
    """Vocabulary and table of both models; ``chosen`` has the ids of the target documents."""
    known, n_words, n_rare = vocabulary(docs, text)
    found = marks(docs, chosen, ids)
    marked, flag = mark_target(docs, found, [], ids, text)
    target, background = counts(marked, text, flag, known)
    any_target = bool(target.any())
    (lt, word_t, none_t), (lb, word_b, none_b) = (log_probabilities(x, n_words) for x in (target if any_target else background, background))
    return Model(known, lt, lb, np.stack([word_t, word_b]), (none_t, none_b), n_rare, any_target, docs, found, ids, text)


def _sent(held: list[tuple[np.ndarray, ...]], bits: int) -> tuple[np.ndarray, list[pa.ListArray]]:
    """Ranges of words, and for each the words, how often each occurs, and of all occurrences the symbol before, after (with the part of the
    document) and the document; rare words before come apart."""
    w, before, after, at = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(w.view(np.uint64))
    w, before, after, at = w[order], before[order], after[order], at[order]
    in_range = (w.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
    ends = np.r_[0, np.flatnonzero(in_range[1:] != in_range[:-1]) + 1, len(w)]
    first = np.r_[0, np.flatnonzero(w[1:] != w[:-1]) + 1]
    words = np.searchsorted(first, ends)
    is_rare = (before < 0) | (before >= VOCABULARY)
    symbol = np.where(is_rare, RARE, before).astype(np.int16)
    return in_range[ends[:-1]], [
        _lists(w[first], words), _lists(np.diff(np.r_[first, len(w)]).astype(np.int32), words), _lists(symbol, ends), _lists(after, ends),
        _lists(at.view(np.int16), ends), _lists(before[is_rare], np.r_[0, np.cumsum(is_rare)][ends])]


def _met(words, sizes, before, after, part, word: np.ndarray, unseen: tuple[float, float], any_target: bool) -> list[np.ndarray]:
    """Log probability that each occurrence of the rare ``words`` adds, by target and background: its own numerator, and all of a frequent word after it."""
    known, code = np.unique(words, return_inverse=True)
    w = np.repeat(code, sizes)
    order = np.lexsort((before, w))
    new = np.r_[True, (w[order][1:] != w[order][:-1]) | (before[order][1:] != before[order][:-1])]
    pair = np.empty_like(w)
    pair[order] = np.cumsum(new) - 1
    follow = np.unique(w * VOCABULARY + after, return_inverse=True)[1]
    out = []
    for m, counted in enumerate((part == TARGET if any_target else part > 0, part > 0)):
        total = lambda group, rows=counted: np.bincount(group, weights=rows)[group]
        own = np.log(total(pair) + PRIOR * (total(w) + 1) * unseen[m])
        above = np.where(after > RARE, np.log(total(follow) + PRIOR * word[m][after]), 0)
        below = np.where(after != START, np.log(total(w, counted & (after != START)) + PRIOR), 0)
        out.append(own + above - below)
    return out


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, ``n_words``, ``target_loss``, ``background_loss`` (mean per word) and ``score``, their difference.

    A frame other than the model's own is scored beside the documents that are counted.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model[1:3])
    known_sent = spark.sparkContext.broadcast(model.known)
    part, txt, row, n, t, b, group, words, sizes, before, after, at, rares, base = fresh(
        [*keep, *df.columns], "part", "txt", "row", "n", "t", "b", "group", "words", "sizes", "before", "after", "at", "rares", "base")
    own_doc = [row, n, t, b]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kept = [f"`{c}` {kinds[c]}" for c in keep]
    same = df is model.docs and text == model.text

    marked, flag = mark_target(model.docs, model.marks, keep if same else [], model.ids, model.text)
    counted = F.when(F.col(flag), TARGET).otherwise(COUNTED)
    if same:
        rows = marked.select(*keep, F.col(text).alias(txt), (counted + SCORED).alias(part))
    else:
        rows = (marked.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in keep], F.col(model.text).alias(txt), counted.alias(part))
                .union(df.select(*keep, F.col(text).alias(txt), F.lit(SCORED).alias(part))))
    bits = max(parts_of(spark), model.n_rare // RANGE, 2).bit_length()
    lists = {words: "long", sizes: "int", before: "smallint", after: "smallint", at: "smallint", rares: "long"}

    def run(batches):
        target, background = sent.value
        coder, held, size, start = Coder(known_sent.value), [], 0, 0

        def sending():
            groups, made = _sent(held, bits)
            nothing = [pa.nulls(len(groups), x) for x in kept_types]
            yield pa.RecordBatch.from_arrays(
                [*nothing, *(pa.nulls(len(groups), x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(groups), *made,
                 pa.array(np.full(len(groups), start))], names=names)

        for batch in batches:
            kept_types = [batch.column(c).type for c in keep]
            for p in pieces(batch, txt, PIECE):
                ids, parts = (p.column(c).to_numpy() for c in (row, part))
                code, length, where, w, prev, follow = coder.codes([x or b"" for x in p.column(txt).cast(pa.binary()).to_pylist()])
                owner = np.repeat(np.arange(len(length)), length)
                if size and (size > HOLD or ids[-1] - start >= SPAN):
                    yield from sending()
                    held, size = [], 0
                if not size:
                    start = int(ids[0])
                doc = owner[where]
                # Rows of a piece are consecutive, so fewer than SPAN unless most of them are blank.
                for k in range(0, len(ids), SPAN):
                    if k:
                        if size:
                            yield from sending()
                        held, size, start = [], 0, int(ids[k])
                    mine = slice(*np.searchsorted(doc, [k, k + SPAN]))
                    if mine.stop > mine.start:
                        held.append((w[mine], prev[mine], (follow[mine] | parts[doc[mine]].astype(np.int64) << 12).astype(np.int16), (ids[doc[mine]] - start).astype(np.uint16)))
                        size += mine.stop - mine.start
                sums = [np.bincount(owner, x[code], minlength=len(length)).astype(float) for x in (target, background)]
                scored = pa.array((parts & SCORED) > 0)
                none = [pa.nulls(len(ids), pa.list_({"long": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}[x])) for x in lists.values()]
                yield pa.RecordBatch.from_arrays(
                    [*[p.column(c) for c in keep], pa.array(ids), pa.array(length), *map(pa.array, sums), pa.array((ids % (1 << bits)).astype(np.int32)), *none,
                     pa.nulls(len(ids), pa.int64())], names=names).filter(scored)
        if size:
            yield from sending()

    names = [*keep, *own_doc, group, *lists, base]
    schema = ", ".join([*kept, f"`{row}` long, `{n}` long, `{t}` double, `{b}` double, `{group}` int", *(f"`{c}` array<{x}>" for c, x in lists.items()), f"`{base}` long"])
    moved = map_arrow(rows.withColumn(row, F.monotonically_increasing_id()), run, schema)
    word, unseen, any_target = model.word, model.unseen, model.any_target

    def meet(table):
        docs = table.filter(table.column(row).is_valid()).select([*keep, *own_doc])
        home = pa.array(docs.column(row).to_numpy() // HOME)
        out = [docs.append_column(group, home)]
        table = table.filter(table.column(base).is_valid())
        if table.num_rows:
            ws, ns, prev, follow, off, rare_before = (table.column(c).combine_chunks().flatten().to_numpy() for c in lists)
            prev = prev.astype(np.int64)
            prev[prev == RARE] = rare_before
            parts, follow = follow >> 12, (follow & (1 << 12) - 1).astype(np.int64)
            added = _met(ws, ns, prev, follow, parts & (TARGET | COUNTED), word, unseen, any_target)
            rows = np.repeat(table.column(base).to_numpy(), pc.list_value_length(table.column(before)).to_numpy()) + off.view(np.uint16)
            scored = (parts & SCORED) > 0
            ids, code = np.unique(rows[scored], return_inverse=True)
            homes = np.unique(ids // HOME)
            ends = np.r_[np.searchsorted(ids, homes * HOME), len(ids)]
            sums = [_lists(np.bincount(code, x[scored], minlength=len(ids)).astype(np.float32), ends) for x in added]
            out.append(pa.table([pa.array(homes), _lists((ids % HOME).astype(np.int16), ends), *sums], names=[group, at, before, after]))
        # Missing columns are null.
        return pa.concat_tables([*out, empty_lists], promote_options="default").select([*keep, *own_doc, group, at, before, after])

    empty_lists = pa.table([pa.array([], pa.list_(x)) for x in (pa.int16(), pa.float32(), pa.float32())], names=[at, before, after])

    def finish(table):
        docs = table.filter(table.column(row).is_valid())
        of = docs.column(row).to_numpy() % HOME
        where = table.column(at).combine_chunks().flatten().to_numpy()
        cols = [docs.column(c) for c in [*keep, n]]
        for own, more in ((t, before), (b, after)):
            total = np.bincount(where, table.column(more).combine_chunks().flatten().to_numpy(), minlength=HOME)
            cols.append(pa.array(-(docs.column(own).to_numpy() + total[of]) / np.maximum(docs.column(n).to_numpy(), 1)))
        return pa.table(cols, names=[*keep, n, t, b])

    sums = moved.groupBy(group).applyInArrow(meet, ", ".join([*kept, f"`{row}` long, `{n}` long, `{t}` double, `{b}` double, `{group}` long, `{at}` array<smallint>, `{before}` array<float>, `{after}` array<float>"]))
    out = sums.groupBy(group).applyInArrow(finish, ", ".join([*kept, f"`{n}` long, `{t}` double, `{b}` double"]))
    return out.select(*keep, F.col(n).alias("n_words"), F.col(t).alias("target_loss"), F.col(b).alias("background_loss"), (F.col(b) - F.col(t)).alias("score"))
