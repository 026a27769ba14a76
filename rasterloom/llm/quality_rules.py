"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Six ratios of each text are compared with fences of its own language and source instead of fixed cutoffs: mean word
length, symbols per word, repeated lines per line, words in repeated 3-word windows per word, ASCII capitals per character
and exclamation marks per word. Mergeable quantile sketches (KLL) hold the deciles of each (lang, source); a group of fewer than `least` documents with words takes the fences of its
language, a language of fewer those of the corpus, from the merged sketches. A fence stands `reach` times the group's own spread (from its
median to its ninth decile; below, to its first) beyond that decile. So the same text passes where its kind is usual and
goes where it isn't. A spread counts as `UNIT` at least, the share that a few marks make in the shortest text that
the base rule lets pass: a group that knows no symbols at all mustn't reject a text for one of them. That decides for
symbols, repeated lines and exclamation marks, which most groups lack; word length, repetition and capitals go by the spread.

The sketches are aggregated map-side before the shuffle, so a source with a third of all rows is no hot key. A sketch keeps all
values of a group up to SKETCH_K of them and is then exact; beyond that the rank of a decile is off by about 0.13 % of the
group at most (k = 4096, 99 % of cases), which moves a fence by `reach` times that step. Small groups have small sketches. Texts are read
once; what is joined is a row of numbers a document. Null texts have no words and fail the base rule; null languages and
sources are groups like others. Repeated rows count and come out each. Clashing extra columns aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import load, ready, table

#: Ratio: least spread that counts. Only mean word length has a lower fence.
UNIT = {"word_length": 0.03, "symbol_ratio": 0.015, "dup_line_ratio": 0.075, "repeat_ratio": 0.006, "upper_ratio": 0.002, "shout_ratio": 0.015}
REACH = 4.0
#: Deciles that the fences are made of.
LOW, MIDDLE, HIGH = 0.1, 0.5, 0.9
LEAST = 50
SKETCH_K = 4096

_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\x0c\r"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang, source and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper, n_shouts. Null texts count as empty."""
    t = docs.select(F.col(id_col), F.col("lang"), F.col("source"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("trimmed", F.btrim("t", F.lit(_BLANKS)))
    t = t.select(
        id_col, "lang", "source",
        F.when(F.col("trimmed") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("trimmed", _SPACE)).alias("w"),
        (F.length("t") - F.length(F.translate("t", _BLANKS, ""))).alias("n_space"),
        F.length("t").alias("n_chars"),
        F.expr("length(t) - length(translate(t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", _CAPITALS, ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).cast("long").alias("n_shouts"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    h = t.select(
        id_col, "lang", "source", "n_symbols", "n_upper", "n_shouts",
        F.size("w").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("n_space")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.size("w") - 2)).alias("h"),
    )
    # windows that occur once need no places: most texts stop at the count of distinct windows
    h = h.withColumn("again", F.size("h") > F.size(F.array_distinct("h")))
    h = h.withColumn("s", F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: x["h"] == F.get("s", k)["h"]
    h = h.withColumn("at", F.sort_array(F.transform(F.filter("s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["i"])))
    # each place covers three words, less what the next one covers
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return h.select(id_col, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_shouts", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def ratios(m: DataFrame) -> DataFrame:
    """The ratios, null for texts without words."""
    some = lambda x: F.when(F.col("n_words") > 0, x)
    return m.withColumns({
        "word_length": some(F.col("word_chars") / F.col("n_words")),
        "symbol_ratio": some(F.col("n_symbols") / F.col("n_words")),
        "dup_line_ratio": some(F.col("n_dup_lines") / F.col("n_lines")),
        "repeat_ratio": some(F.col("n_repeat_words") / F.col("n_words")),
        "upper_ratio": some(F.col("n_upper") / F.col("word_chars")),
        "shout_ratio": some(F.col("n_shouts") / F.col("n_words")),
    })


def fences(r: DataFrame, least: int = LEAST, reach: float = REACH, k: int = SKETCH_K) -> DataFrame:
    """(lang, source, low_word_length, high_<ratio>...), one row for each group of r."""
    own = r.groupBy("lang", "source").agg(F.count("word_length").alias("n"), *[F.kll_sketch_agg_double(x, k).alias(x) for x in UNIT])
    own = table(own, "sketches")
    merge = lambda d, *by: d.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(x, k).alias(x) for x in UNIT])
    lang = merge(own, "lang")
    corpus = merge(own)
    up = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in d.columns])
    g = own.join(up(lang, "l_"), F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(up(corpus, "c_")))  # one row
    pick = lambda x: F.when(F.col("n") >= least, F.col(x)).when(F.col("l_n") >= least, F.col(f"l_{x}")).when(F.col("c_n") > 0, F.col(f"c_{x}"))
    g = g.select("lang", "source", *[F.kll_sketch_get_quantile_double(pick(x), F.array(F.lit(LOW), F.lit(MIDDLE), F.lit(HIGH))).alias(x) for x in UNIT])
    beyond = lambda x, k: F.lit(reach) * F.greatest(F.abs(F.col(x)[k] - F.col(x)[1]), F.lit(UNIT[x]))
    return g.select("lang", "source", (F.col("word_length")[0] - beyond("word_length", 0)).alias("low_word_length"), *[(F.col(x)[2] + beyond(x, 2)).alias(f"high_{x}") for x in UNIT])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """measures() and ratios() of each document, base_failed, its fences and kept."""
    ready(docs.sparkSession)
    r = ratios(table(measures(docs, id_col, text_col), "measures"))
    f = table(fences(r, **how), "fences").select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "low_word_length", *[f"high_{x}" for x in UNIT])
    d = r.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = reduce(lambda a, b: a | b, [F.col(x) > F.col(f"high_{x}") for x in UNIT], F.col("word_length") < F.col("low_word_length"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(beyond, F.lit(False)))


def op7_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    return judged(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _decile_sql(by: str) -> str:
    return ", ".join(f"quantile_disc({x}, {q}) AS {p}_{x}" for x in UNIT for q, p in ((LOW, "q1"), (MIDDLE, "q5"), (HIGH, "q9"))) + f", count(word_length) AS n FROM r {by}"


def _fence_sql(x: str) -> str:
    pick = lambda q: f"CASE WHEN o.n >= {LEAST} THEN o.{q}_{x} WHEN l.n >= {LEAST} THEN l.{q}_{x} ELSE c.{q}_{x} END AS {q}_{x}"
    return ", ".join(map(pick, ("q1", "q5", "q9")))


def _reach_sql(x: str, q: str) -> str:
    return f"{REACH} * greatest(abs({q}_{x} - q5_{x}), {UNIT[x]})"


#: Exact deciles; the sketches are exact too up to SKETCH_K documents a group.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS c FROM win) WHERE c > 1) GROUP BY id),
ln AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT d.id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_shouts, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN ln ON d.id = ln.id LEFT JOIN rep ON d.id = rep.id),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words END AS word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_dup_lines / n_lines END AS dup_line_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words END AS repeat_ratio,
    CASE WHEN n_words > 0 THEN n_upper / word_chars END AS upper_ratio, CASE WHEN n_words > 0 THEN n_shouts / n_words END AS shout_ratio FROM m),
o AS (SELECT lang, source, {_decile_sql("GROUP BY lang, source")}),
l AS (SELECT lang, {_decile_sql("GROUP BY lang")}),
c AS (SELECT {_decile_sql("")}),
q AS (SELECT o.lang, o.source, {", ".join(map(_fence_sql, UNIT))} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN c),
j AS (
  SELECT r.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    coalesce(word_length < q1_word_length - {_reach_sql("word_length", "q1")}
      OR {" OR ".join(f"{x} > q9_{x} + {_reach_sql(x, 'q9')}" for x in UNIT)}, false) AS beyond
  FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM j
"""
