"""Quality rules with thresholds that adapt to each language and source.

Every metric of a document is a whole number. Its bin in a logarithmic-linear
histogram (64 bins for each doubling: at most 1/64 relative error) is found with
integer arithmetic only, so the histogram is a quantile sketch that merges by
adding counts and gives the same answer in any order and on any engine. Counts
are summed per (lang, source, metric, bin), and merged to sketches of each language
and of the corpus. Quartiles are read off the summed bins; those of a source are
shrunk to those of its language, as if `prior` more documents had these, and those of a
language likewise to the corpus: small groups lean on the larger ones and there is no
size at which the rule changes. A document fails where a metric lies more than `width`
interquartile ranges outside its own group's quartiles. Where a group's range is below
RESOLUTION its language's counts, then the corpus's, and RESOLUTION if that is no wider.
This is one number for all metrics, per word: it stands for metrics that are 0 in most
documents, whose quartiles say nothing of their spread. No metric has a constant of its own.

Built from DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, load, table, text_of

SCALE = 10_000  # metrics are whole numbers of this part of one
#: metric -> (numerator, denominator, tested below too)
METRICS = {
    "word_len": ("word_chars", "n_words", True),
    "symbols": ("n_symbols", "n_words", False),
    "upper": ("n_upper", "n_words", False),
    "dup_lines": ("n_dup_lines", "n_words", False),
    "repeats": ("n_repeat_words", "n_words", False),
}
WIDTH, PRIOR, RESOLUTION, MIN_WORDS, MAX_REPEAT_PERCENT = 4, 50, 250, 50, 50
GROUPS_BROADCAST = 100_000


def _repeat_words(words: str) -> Column:
    """Words covered by 3-word windows that occur at least twice in the text.

    transform(array(x), name -> ...)[0] binds a value to a name: it is worked out
    once and not again for each element. Windows are sorted by 64-bit hash, so the
    equal ones are neighbours; the words are then compared themselves.
    """
    same = lambda a, b: f"(s[{a}].h = s[{b}].h and w[s[{a}].i] = w[s[{b}].i] and w[s[{a}].i + 1] = w[s[{b}].i + 1] and w[s[{a}].i + 2] = w[s[{b}].i + 2])"
    return F.expr(f"""
      case when size({words}) < 3 then 0L else
      transform(array({words}), w ->
        transform(array(sort_array(transform(slice(w, 1, size(w) - 2), (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) as h, i as i)))), s ->
          aggregate(
            sort_array(transform(filter(s, (x, j) -> (j > 0 and {same("j - 1", "j")}) or (j + 1 < size(s) and {same("j + 1", "j")})), x -> x.i)),
            struct(0L as n, -3 as last),
            (a, i) -> struct(a.n + cast(least(3, i - a.last) as bigint) as n, i as last),
            a -> a.n))[0])[0] end""")


def text_metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines and n_repeat_words (columns of these names are replaced)."""
    made = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")
    base = docs.drop(*made)
    text, words, lines = text_of(), free_name(docs, "__w"), free_name(docs, "__l")
    base = base.withColumns({words: F.filter(F.split(text, SPACE), lambda w: w != ""), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    gone = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    size = lambda c: F.size(c).cast("long")
    return base.withColumns(
        {
            "n_words": size(F.col(words)),
            "word_chars": F.aggregate(F.col(words), F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
            "n_symbols": (F.char_length(text) - gone(r"[#*$%&|<>]+")).cast("long"),
            "n_upper": (F.char_length(text) - gone(r"\p{Lu}+")).cast("long"),
            "n_lines": size(F.col(lines)),
            "n_dup_lines": size(F.col(lines)) - size(F.array_distinct(F.col(lines))),
            "n_repeat_words": _repeat_words(words),
        }
    ).drop(words, lines)


def _metric(name: str) -> Column:
    top, bottom = METRICS[name][:2]
    return F.expr(f"case when {bottom} > 0 then ({top} * {SCALE}L) div {bottom} else 0L end")


def _bin(v: str) -> str:
    return f"case when {v} < 128 then {v} else (length(bin({v})) - 7) * 64L + shiftright({v}, length(bin({v})) - 7) end"


def _edge(b: str) -> str:
    """The largest value of a bin."""
    return f"case when {b} < 128 then {b} else shiftleft({b} - 64L * (({b} - 64) div 64) + 1L, cast(({b} - 64) div 64 as int)) - 1L end"


def fences(measured: DataFrame, width: int = WIDTH, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source) with docs, low_<metric> and high_<metric>.

    Hot groups cost nothing extra: counts are summed on the map side, and a group has
    at most a few thousand bins whatever its number of documents.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _metric(m).alias("v")) for m in METRICS]))
    bins = measured.select("lang", "source", pairs.alias("p")).selectExpr("lang", "source", "p.metric", f"{_bin('p.v')} as bin").groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))
    bins = table(bins, "quality-bins")
    names = [f"q{k}_{m}" for m in METRICS for k in (1, 3)]

    def quartiles(keys: list[str], sketch: DataFrame) -> DataFrame:
        w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)], "metric")  # a group's bins, not its documents
        at = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)}).withColumn("edge", F.expr(_edge("bin")))
        first = lambda k, m: F.min(F.when((F.col("metric") == m) & (F.col("upto") * 4 >= F.col("all") * k), F.col("edge")))
        return at.groupBy(*keys).agg(F.max("all").alias("docs"), *[first(k, m).alias(f"q{k}_{m}") for m in METRICS for k in (1, 3)])

    def shrunk(c: str) -> Column:
        return F.expr(f"(docs * {c} + {prior}L * {c}_) div (docs + {prior}L)")

    langs = bins.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    every = quartiles([], langs.groupBy("metric", "bin").agg(F.sum("n").alias("n"))).select(*[F.col(c).alias(f"{c}_") for c in names])
    spreads = lambda mark="": {f"r_{m}": F.col(f"q3_{m}{mark}") - F.col(f"q1_{m}{mark}") for m in METRICS}
    first = lambda m: F.expr(f"case when q3_{m} - q1_{m} >= {RESOLUTION} then q3_{m} - q1_{m} else r_{m} end").alias(f"r_{m}")
    resolved = {m: F.greatest(F.col(f"r_{m}"), F.lit(RESOLUTION).cast("long")) for m in METRICS}
    langs = quartiles(["lang"], langs).join(F.broadcast(every.withColumns(spreads("_"))), F.lit(True))  # one row
    langs = langs.select("lang", *[shrunk(c).alias(c) for c in names], *[f"r_{m}" for m in METRICS])
    langs = langs.select(F.col("lang").alias("lang_"), *[F.col(c).alias(f"{c}_") for c in names], *[first(m) for m in METRICS])
    own = quartiles(["lang", "source"], bins).join(langs, F.col("lang").eqNullSafe(F.col("lang_")))
    own = own.select("lang", "source", "docs", *[shrunk(c).alias(c) for c in names], *[f"r_{m}" for m in METRICS])
    own = own.select("lang", "source", "docs", *names, *[first(m) for m in METRICS]).withColumns({f"r_{m}": c * width for m, c in resolved.items()})
    low = [(F.col(f"q1_{m}") - F.col(f"r_{m}")).alias(f"low_{m}") for m in METRICS if METRICS[m][2]]
    return own.select("lang", "source", "docs", *low, *[(F.col(f"q3_{m}") + F.col(f"r_{m}")).alias(f"high_{m}") for m in METRICS])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with base_failed, failed (names of the metrics outside their fences) and kept."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in measured.columns):
        mark += "_"
    limits = limits.drop("docs").withColumnsRenamed({c: mark + c for c in limits.columns})
    limits = table(limits, "quality-fences")
    if limits.count() <= GROUPS_BROADCAST:
        limits = F.broadcast(limits)
    joined = measured.drop("base_failed", "failed", "kept").join(limits, F.col("lang").eqNullSafe(F.col(f"{mark}lang")) & F.col("source").eqNullSafe(F.col(f"{mark}source")), "left")
    bad = []
    for m in METRICS:
        outside = _metric(m) > F.col(f"{mark}high_{m}")
        if METRICS[m][2]:
            outside = outside | (_metric(m) < F.col(f"{mark}low_{m}"))
        bad.append(F.when(outside, F.lit(m)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.select(*[measured[c] for c in measured.columns if c not in ("base_failed", "failed", "kept")], base.alias("base_failed"), F.filter(F.array(*bad), lambda x: x.isNotNull()).alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality_rules(docs: DataFrame, width: int = WIDTH, prior: int = PRIOR) -> DataFrame:
    """Every row of docs (needs text, lang, source) with its metrics, base_failed, failed and kept.

    Null text counts as empty and fails (fewer than 50 words). Null lang or source is
    a group of its own. Repeated rows are judged each. Other columns are carried; those
    named like the added ones are replaced. An empty table gives an empty result.
    """
    measured = table(text_metrics(docs), "quality-metrics")
    return judge(measured, fences(measured, width, prior))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_metrics(load(spark, sf_dir, "documents")).drop("text", "n_chars")
    measured = table(docs, "quality-metrics")
    return judge(measured, fences(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    bins = "CASE WHEN v < 128 THEN v ELSE (length(bin(v)) - 7) * 64 + (v >> (length(bin(v)) - 7)) END"
    edge = "CASE WHEN bin < 128 THEN bin ELSE ((bin - 64 * ((bin - 64) // 64) + 1) << ((bin - 64) // 64)) - 1 END"
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {x[2]} AS two, CASE WHEN {x[1]} > 0 THEN ({x[0]} * {SCALE}) // {x[1]} ELSE 0 END AS v FROM measured" for m, x in METRICS.items())

    def quartiles(keys: str, sketch: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        return f"""SELECT {by}, CAST(max(total) AS BIGINT) AS total, CAST(min(CASE WHEN upto * 4 >= total THEN {edge} END) AS BIGINT) AS q1, CAST(min(CASE WHEN upto * 4 >= total * 3 THEN {edge} END) AS BIGINT) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {sketch}) GROUP BY ALL"""

    def shrunk(up: str) -> str:
        return ", ".join(f"(o.total * o.{q} + {PRIOR} * {up}.{q}) // (o.total + {PRIOR}) AS {q}" for q in ("q1", "q3"))

    return f"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM base),
grams AS (SELECT doc_id, i, x || ' ' || lead(x) OVER d || ' ' || lead(x, 2) OVER d AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) t(k) WHERE n > 1 GROUP BY doc_id),
measured AS (SELECT b.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (doc_id)),
vals AS ({values}),
binned AS (SELECT *, {bins} AS bin FROM vals),
own AS (SELECT lang, source, metric, bin, count(*) AS n FROM binned GROUP BY ALL),
langs AS (SELECT lang, metric, bin, sum(n) AS n FROM own GROUP BY ALL),
everything AS (SELECT metric, bin, sum(n) AS n FROM langs GROUP BY ALL),
all_q AS ({quartiles("", "everything")}),
lang_s AS (SELECT o.lang, o.metric, {shrunk("a")}, a.q3 - a.q1 AS r FROM ({quartiles("lang", "langs")}) o JOIN all_q a USING (metric)),
lang_q AS (SELECT lang, metric, q1, q3, CASE WHEN q3 - q1 >= {RESOLUTION} THEN q3 - q1 ELSE r END AS r FROM lang_s),
own_s AS (SELECT o.lang, o.source, o.metric, {shrunk("g")}, g.r FROM ({quartiles("lang, source", "own")}) o JOIN lang_q g ON o.lang IS NOT DISTINCT FROM g.lang AND o.metric = g.metric),
own_r AS (SELECT lang, source, metric, q1, q3, CASE WHEN q3 - q1 >= {RESOLUTION} THEN q3 - q1 ELSE r END AS r FROM own_s),
limits AS (SELECT lang, source, metric, q1, q3, {WIDTH} * greatest(r, {RESOLUTION}) AS r FROM own_r),
bad AS (SELECT v.doc_id, bool_or(v.v > q3 + r OR (two AND v.v < q1 - r)) AS bad
  FROM vals v LEFT JOIN limits t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.metric = t.metric GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT bad AS kept
FROM measured JOIN bad USING (doc_id)"""
