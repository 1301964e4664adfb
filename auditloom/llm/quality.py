"""Quality rules by distribution divergence, in DataFrame functions only.

Every text becomes two histograms: character classes, and how often each of a list of common words
occurs.  Both are compared with the histograms of each language by the Jensen-Shannon distance
(base 2, so 0 to 1); the nearest language counts.  Histograms of short texts say little, so each
distance is only used above a minimum length.

Texts are read once: the counts are written beside the rows in the shared folder, the references are
sums of those counts per language (one row for each language leaves a task), and the verdict is an
expression over the written counts.

Defined cases: null and empty texts have no words and fail the base rule; a text may be as long as a
row may be; repeated rows are judged each for itself; an empty table gives no rows; languages are only
labels of the references, null is left out of them; without any reference only the base rule is used.
Columns of the input keep their names, added ones avoid them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.llm.common import fresh
from auditloom.plans.lineage import cut

#: Function words of English, German, French and Spanish.
COMMON_WORDS = tuple(
    "the of and to in is that it for as with was on are this be at by from or "
    "der die und das von zu mit sich des auf für nicht ein eine als auch dem den ist "
    "le la les et des un une du que qui dans est pour pas sur par elle avec au de en "
    "el los las y se por con para su como más del lo no".split())
COMMON_WORDS = tuple(dict.fromkeys(COMMON_WORDS))
CLASSES = ("upper", "digit", "symbol", "punct", "space", "rest")
WORD_GAP = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
PUNCT = ".,;:!?'\"()\\-"

#: A text is rejected when its nearest language is further away than this.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.70
#: Guards: characters, and common words found, below which a distance is not used.
MIN_CHARS = 200
MIN_COMMON = 30
#: A language is a reference when it has at least one of so many labelled rows, so there are fewer than that.
REFERENCE_SHARE = 256


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more."""
    n = F.size(words)

    def count(h: Column) -> Column:
        def marked(s: Column) -> Column:
            same = F.filter(F.transform(s, lambda x, i: F.when(
                (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda i: F.array(i, i + 1, i + 2)))))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(pairs, marked))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(_bind(windows, count)).cast("long")


def counts(text: Column) -> Column:
    """Struct of the base counts and both histograms of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    marks = F.regexp_replace(t, f"[^\\p{{Lu}}0-9{SYMBOLS}{PUNCT}]+", "")
    number = lambda s, of: F.regexp_count(s, F.lit(of))

    def base(k: Column) -> Column:
        m, dup = k["marks"], F.size(k["lines"]) - F.size(F.array_distinct(k["lines"]))
        upper, digit, symbol, punct = number(m, "\\p{Lu}"), number(m, "[0-9]"), number(m, f"[{SYMBOLS}]"), number(m, f"[{PUNCT}]")
        return F.struct(
            dup.cast("long").alias("n_dup_lines"), symbol.cast("long").alias("n_symbols"),
            F.array(upper, digit, symbol, punct).alias("classes"))

    def rest(words: Column) -> Column:
        common = F.array_join(F.filter(words, lambda w: w.isin(*COMMON_WORDS)), "  ")

        def found(joined: Column) -> Column:
            return F.array(*[
                ((F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("int")
                for w in COMMON_WORDS])

        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated(words).alias("n_repeat_words"),
            _bind(F.concat(F.lit(" "), common, F.lit(" ")), found).alias("common"),
        )

    return F.struct(
        F.length(t).cast("long").alias("n_chars"), _bind(F.struct(marks.alias("marks"), lines.alias("lines")), base).alias("base"),
        _bind(F.array_remove(F.split(t, WORD_GAP), ""), rest).alias("words"))


def class_counts(c: Column) -> Column:
    """Upper case, digits, symbols, punctuation, space, all others."""
    n, marks = c["n_chars"], c["base"]["classes"]
    space = n - c["words"]["word_chars"]
    four = [F.get(marks, F.lit(i)).cast("long") for i in range(4)]
    return F.array(*four, space, n - space - four[0] - four[1] - four[2] - four[3])


def _shares(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    return F.transform(hist, lambda x: F.try_divide(x, total))  # nulls for an empty histogram


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def fit_references(counted: DataFrame, lang: str, c: str) -> list:
    """One row per language with both histograms, from rows that pass the base rule.  Fewer than ``REFERENCE_SHARE``."""
    good = counted.where(F.col(lang).isNotNull() & ~base_failed(F.col(c))).select(
        F.col(lang).alias("lang"), class_counts(F.col(c)).alias("classes"), F.col(c)["words"]["common"].alias("common"))
    hist = lambda f, n: F.array(*[F.sum(F.get(F.col(f), F.lit(i)).cast("double")) for i in range(n)])
    by = good.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), hist("classes", len(CLASSES)).alias("classes"), hist("common", len(COMMON_WORDS)).alias("common"))
    total = by.select(F.sum("n")).scalar()
    return (by.where(F.col("n") * REFERENCE_SHARE >= total)
            .select("lang", _shares(F.col("classes")).alias("classes"), _shares(F.col("common")).alias("common")).collect())


def base_failed(c: Column) -> Column:
    n, r = c["words"]["n_words"], c["words"]["n_repeat_words"]
    return (n < 50) | (100 * r > 50 * n)


def judge(df: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` (all) of ``df`` with the judgement, and the names under which its parts were added.

    Parts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance (null below their guards), kept.
    """
    parts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    keep = df.columns if keep is None else keep
    names = dict(zip(parts, fresh(df.columns, *parts), strict=True))
    c, own = fresh([*df.columns, *names.values()], "counts", "lang")
    counted = cut(df.withColumns({c: counts(F.col(text)), own: F.col(lang)}).select(*keep, own, c))
    refs = fit_references(counted, own, c)
    col = F.col(c)

    def nearest(hist: Column, field: str, enough: Column) -> Column:
        known = [r[field] for r in refs if r[field][0] is not None]
        if not known:
            return F.lit(None).cast("double")
        known = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in known])
        return F.when(enough, _bind(_shares(hist), lambda p: F.array_min(F.transform(known, lambda q: js_distance(p, q)))))

    common = col["words"]["common"]
    out = counted.withColumns({
        names["n_words"]: col["words"]["n_words"], names["word_chars"]: col["words"]["word_chars"],
        names["n_symbols"]: col["base"]["n_symbols"], names["n_dup_lines"]: col["base"]["n_dup_lines"],
        names["n_repeat_words"]: col["words"]["n_repeat_words"], names["base_failed"]: base_failed(col),
        names["class_distance"]: nearest(class_counts(col), "classes", col["words"]["word_chars"] >= MIN_CHARS),
        names["word_distance"]: nearest(common, "common", F.aggregate(common, F.lit(0), lambda a, x: a + x) >= MIN_COMMON),
    })
    far = (F.coalesce(F.col(names["class_distance"]), F.lit(0.0)) > MAX_CLASS_DISTANCE) | (
        F.coalesce(F.col(names["word_distance"]), F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn(names["kept"], ~F.col(names["base_failed"]) & ~far).drop(c, own), names


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass, with the columns they came with."""
    out, names = judge(df, text, lang)
    return out.where(F.col(names["kept"])).select(*df.columns)
