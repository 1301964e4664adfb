"""Registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.llm import bpe, collocations, contamination, filter_audit, langid, lm, neardup, pii, quality, repeats, token_counts, toxicity, urls
from auditloom.llm.common import table
from auditloom.queries.base import Area

#: Vocabulary files.
RANKS, MERGES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")

AREA = Area()
QUERIES, ORACLE = AREA.queries, AREA.oracle


def _count_sql(kind: str) -> str:
    return f"length(regexp_replace(t, '[^{kind}]', '', 'g'))"


_COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in quality.COMMON_WORDS) + "]"
_PUNCT_SQL = quality.PUNCT.replace("'", "''")
OP9_SQL = rf"""WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM base),
windows AS (SELECT r, k, COUNT(*) OVER (PARTITION BY r, w[k], w[k + 1], w[k + 2]) AS n
  FROM split, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS k)),
repeats AS (SELECT r, COUNT(DISTINCT p) AS n FROM windows, LATERAL (SELECT unnest(range(k, k + 3)) AS p) WHERE windows.n > 1 GROUP BY r),
counted AS (SELECT split.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count_sql(quality.SYMBOLS)} AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
  {_count_sql(chr(92) + 'p{Lu}')} AS upper, {_count_sql('0-9')} AS digit, {_count_sql(_PUNCT_SQL)} AS punct,
  list_transform({_COMMON_SQL}, lambda c: len(list_filter(w, lambda x: x = c))) AS common FROM split LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(t) - word_chars AS space,
  [upper, digit, n_symbols, punct, length(t) - word_chars, word_chars - upper - digit - n_symbols - punct] AS classes FROM counted),
hists AS (SELECT r, lang, base_failed, h, unnest(v) AS v, generate_subscripts(v, 1) AS i
  FROM (SELECT r, lang, base_failed, 'c' AS h, classes AS v FROM judged UNION ALL SELECT r, lang, base_failed, 'w', common FROM judged)),
known AS (SELECT lang FROM judged WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang
  HAVING COUNT(*) * {quality.REFERENCE_SHARE} >= (SELECT COUNT(*) FROM judged WHERE lang IS NOT NULL AND NOT base_failed)),
sums AS (SELECT lang, h, i, SUM(v)::DOUBLE AS v FROM hists WHERE NOT base_failed AND lang IN (SELECT lang FROM known) GROUP BY ALL),
refs AS (SELECT lang, h, i, v / SUM(v) OVER (PARTITION BY lang, h) AS q FROM sums),
shares AS (SELECT r, h, i, v / nullif(SUM(v) OVER (PARTITION BY r, h), 0) AS p FROM hists),
far AS (SELECT r, h, refs.lang, sqrt(greatest(0, SUM(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM shares JOIN refs USING (h, i) GROUP BY r, h, refs.lang),
near AS (SELECT r, MIN(d) FILTER (WHERE h = 'c') AS c, MIN(d) FILTER (WHERE h = 'w') AS w FROM far GROUP BY r),
final AS (SELECT judged.*, CASE WHEN word_chars >= {quality.MIN_CHARS} THEN near.c END AS cd,
  CASE WHEN list_sum(common) >= {quality.MIN_COMMON} THEN near.w END AS wd FROM judged LEFT JOIN near USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {quality.MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= {quality.MAX_WORD_DISTANCE} AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM final"""


@AREA.query("op9_quality_divergence", OP9_SQL)
def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(n[c]).alias(c) for c in cols], *[F.round(n[c], 6).alias(c) for c in ("class_distance", "word_distance")])


@AREA.query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), RANKS, ["doc_id"])
    both = bpe.decode(ids, RANKS, ["doc_id", "ids"])
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@AREA.query("op6_prefix_token_counts")
def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (token_counts.count_tokens(table(spark, sf_dir, "documents"), MERGES, ["doc_id"], budget=1024)
            .withColumn("over_limit", F.col("n_tokens") > 1024))


def _words_sql(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP10_SQL = f"""WITH items AS (SELECT item_id::VARCHAR AS item, {_words_sql('text')} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, len(x) AS n, x FROM (
  SELECT item, CASE WHEN len(w) < 13 THEN w ELSE list_slice(w, k, k + 12) END AS x
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 11, 2))) AS k) WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
windows AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS x
  FROM docs, (SELECT DISTINCT n FROM phrases) AS sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)),
hits AS (SELECT doc_id, item, s, windows.n FROM windows JOIN phrases ON windows.n = phrases.n AND windows.x = phrases.x),
hit_words AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(s, s + n)) AS p) GROUP BY doc_id),
hit_items AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


@AREA.query("op10_fm_index", OP10_SQL)
def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (n_words, hits, items) = contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", F.col(n_words).alias("n_words"), contamination.n_hit(hits).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256).alias("items_sha256"),
        contamination.contaminated(n_words, hits).alias("contaminated"))


@AREA.query("op7_prob_minhash")
def op7_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, cls = neardup.with_class(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col(cls).alias("class_id"))


#: Verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def fold(column: str, n: int):
    """crc32 of an id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


@AREA.query("op4_bigru_toxicity")
def op4_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) > 0)
    net = toxicity.fit(toxicity.sample(docs, labels))
    return toxicity.score(docs, net, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@AREA.query("op8_hyperdimensional_language")
def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3).isin(0, 2)))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@AREA.query("op3_skip_chain_pii")
def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.learn(docs), ["doc_id"])
    number = lambda kind: F.size(F.filter("base", lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, pii.KINDS),
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


@AREA.query("op1_link_propagation")
def op1_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = urls.judge(table(spark, sf_dir, "pages"), URL_RULES, ["page_id"])
    return out.select("page_id", *[F.col(n[c]).alias(c) for c in ("host", "path", "rule", "verdict", "trust", "distrust")])


@AREA.query("op2_cross_entropy_difference")
def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm.score(docs, lm.fit(docs, good), ["doc_id"])


OP11_SQL = r"""WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM base),
failing AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(MIN(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM split),
marks AS (SELECT doc_id, MAX((quality = 1)::INT) AS good, MAX((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counted AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
  COUNT(*) AS n, SUM(coalesce(good, 0)) AS good, SUM(coalesce(toxic, 0)) AS toxic FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
seen AS (SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS hit,
  len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM counted, steps),
removals AS (SELECT part, f, SUM(n) AS shapley FROM seen WHERE hit AND NOT gone GROUP BY ALL)
SELECT part, filter_order, step, coalesce(SUM(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept,
  coalesce(SUM(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed, coalesce(SUM(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant,
  coalesce(SUM(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails, coalesce(SUM(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(SUM(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost, coalesce(ANY_VALUE(shapley), 0)::BIGINT AS shapley
FROM seen LEFT JOIN removals USING (part, f) GROUP BY part, filter_order, step"""


@AREA.query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
parts AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n-\r]')) AS p FROM docs),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM parts),
totals AS (SELECT lang, SUM(len(w))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, COUNT(*) AS f
  FROM lists, (SELECT unnest(range(1, 6)) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) GROUP BY ALL HAVING COUNT(*) >= 100),
candidates AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM candidates c, LATERAL (SELECT unnest(range(1, size)) AS j) JOIN totals ON totals.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, j), ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, j + 1, size), ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
dropped AS (SELECT DISTINCT lang, a, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase
  FROM candidates, LATERAL (SELECT unnest(range(2, size)) AS m), LATERAL (SELECT unnest(range(1, size - m + 2)) AS s)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = best.lang AND d.phrase = best.phrase AND 100 * d.a >= 100 * best.a))
SELECT * FROM ranked WHERE rank <= 2000"""


@AREA.query("op12_phrase_collocations", OP12_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@AREA.query("op13_suffix_repeats")
def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = repeats.without_repeats(table(spark, sf_dir, "documents"), ["doc_id"], digest=True)
    return out.select("doc_id", *[F.col(n[c]).alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.col(n["kept"]).alias("kept_sha256"))
