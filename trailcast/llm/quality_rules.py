"""Quality rules with adaptive thresholds (dealt operator 13, native): DataFrame functions only.

Each whole text gives counts (:func:`facts`): words, their code points, symbols, lines with a
word and those equal to an earlier one, and words in 3-word windows that the text holds twice
or more. Windows are compared as text, after a sort within the row. From the counts come
integer measures (:data:`MEASURES`): word length in thousandths, and the shares of symbols,
repeated lines and repeated words in millionths.

No measure has a fixed cutoff. :func:`sketch` counts the measures of the documents that pass
the base rules in log-linear bins (:func:`bin_of`: 128 bins to a power of two, so a quantile is
at most 1/128 off) per language, source and measure. Sketches are tables of counts: they are merged by adding them up
(:func:`merge`), between runs and between groups, and don't depend on order or partitions. A
group's fences lie ``WIDTH`` times its quartile distance outside its quartiles, the distance
being at least the measure's least spread. Groups of under ``MIN_DOCS`` documents use the
merged sketch of their language, and if that is as small, the one of all documents.
:func:`judge` joins the facts with the fences of their group and filters.

How it scales: one pass over the texts writes the narrow facts; the sketch is one aggregation
with partial counts (a hot source costs its bins, not its rows); fences are computed over bins.
The join's fence side has a row a group; Spark broadcasts it if it measures small, and splits
the rows of a hot source otherwise. A text's words and windows are held by its task, about
200 bytes a word.

Defined cases: a null text has no words; a text without words has measures 0 and fails the
base rules; null languages and sources are groups of their own; equal rows give equal rows;
documents that fail the base rules are in no sketch; a measure without any document in its
sketches has no fences, so nothing fails it; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailcast.llm.scratch import Scratch

BLANKS = "\t\n\x0b\x0c\r "
MIN_WORDS, MAX_REPEATED, MIN_DOCS, WIDTH, BINS = 50, 50, 50, 3, 128
#: measure: (numerator times, numerator, denominator, checks below, least spread, and as a share of the median in percent)
MEASURES = {
    "word_length": (1000, "word_chars", "n_words", True, 100, 10),
    "symbols": (1000000, "n_symbols", "word_chars", False, 20000, 0),
    "dup_lines": (1000000, "n_dup_lines", "n_lines", False, 200000, 0),
    "repeats": (1000000, "n_repeat_words", "n_words", False, 150000, 0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _once(value: Column, build) -> Column:
    """``build`` of a value that is computed once (a lambda's variable holds it)."""
    return F.element_at(F.transform(F.array(value), build), 1)


def _repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more, overlaps included."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def places(s):
        same = lambda a, b: F.coalesce(F.get(s, a)["w"] == F.get(s, b)["w"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k + 1) | same(k - 1, k))
        covered = F.transform(twice, lambda k: _once(F.get(s, k)["i"], lambda i: F.array(i, i + 1, i + 2)))
        return F.size(F.array_distinct(F.flatten(covered)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_once(F.array_sort(windows), places))


def facts(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the counts of every whole text (longs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x09-\\x0D\\x20]+", -1))
    by_word = _once(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    by_line = _once(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), by_word.alias("by_word"), by_line.alias("by_line"), symbols.alias("n_symbols"))
    place = {"n_words": "by_word.n_words", "word_chars": "by_word.word_chars", "n_repeat_words": "by_word.n_repeat_words", "n_lines": "by_line.n_lines", "n_dup_lines": "by_line.n_dup_lines"}
    return rows.select(*keep, *(F.col(place.get(n, n)).cast("long").alias(n) for n in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def measure(name: str) -> Column:
    times, top, bottom, *_ = MEASURES[name]
    return F.when(F.col(bottom) == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", times * F.col(top), F.col(bottom)))


def bin_of(value: Column) -> Column:
    """Bin of a value >= 0: itself below 2 * BINS, then BINS bins to each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - (BINS.bit_length()), F.lit(0))
    return BINS * shift + F.call_function("shiftright", value, shift)


def low_edge(b: Column) -> Column:
    """Least value of a bin."""
    shift = F.greatest(F.floor(b / BINS).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", b - BINS * shift, shift)


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of facts with lang and source."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(measure(m)).alias("bin")) for m in MEASURES)))
    return rows.where(~base_failed()).select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.measure", "e.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up, by all or some of lang and source."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, docs, low, high) of merged sketches: quartiles from the bins, moved out."""
    group = Window.partitionBy(*keys, "measure")            # a group's bins, not its rows
    counts = merge(sketches, *keys).withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "docs": F.sum("n").over(group)})
    quartile = lambda k: low_edge(F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bin")))).alias(f"q{k}")
    rows = counts.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), *(quartile(k) for k in (1, 2, 3)))
    spread = F.lit(0)
    for m, (*_, least, percent) in MEASURES.items():
        spread = F.when(F.col("measure") == m, F.greatest(F.lit(least), F.floor(percent * F.col("q2") / 100))).otherwise(spread)
    spread = WIDTH * F.greatest(F.col("q3") - F.col("q1"), spread)
    return rows.select(*keys, "measure", "docs", (F.col("q1") - spread).cast("long").alias("low"), (F.col("q3") + spread).cast("long").alias("high"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): <measure>_low and <measure>_high, from the nearest of the
    group's, its language's and the whole sketch that holds MIN_DOCS documents (the whole one if
    none does)."""
    group = fences(sketches, "lang", "source")
    lang = fences(sketches, "lang").select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.struct("docs", "low", "high").alias("by_lang"))
    every = fences(sketches).select(F.col("measure").alias("a_measure"), F.struct("docs", "low", "high").alias("by_all"))
    rows = (group.select("lang", "source", "measure", F.struct("docs", "low", "high").alias("own"))
            .join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")), "left")
            .join(every, F.col("measure") == F.col("a_measure"), "left"))
    used = F.when(F.col("own.docs") >= MIN_DOCS, F.col("own")).when(F.col("by_lang.docs") >= MIN_DOCS, F.col("by_lang")).otherwise(F.col("by_all"))
    rows = rows.select("lang", "source", "measure", used.alias("used"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col("used")[side])).alias(f"{m}_{side}")
    return rows.groupBy("lang", "source").agg(*(pick(m, side) for m in MEASURES for side in ("low", "high")))


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (facts) with base_failed, failed (names of the measures outside their fences)
    and kept."""
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    out = []
    for m, (*_, below, _least, _percent) in MEASURES.items():
        bad = measure(m) > F.col(f"{m}_high")
        if below:
            bad = bad | (measure(m) < F.col(f"{m}_low"))
        out.append(F.when(bad, F.lit(m)))
    failed = F.array_compact(F.array(*out))
    return (joined.withColumn("base_failed", base_failed()).withColumn("failed", failed)
            .select(*rows.columns, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept")))


def _keep(docs: DataFrame, id_col: str, lang_col: str, source_col: str) -> dict[str, Column]:
    text = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return {id_col: F.col(id_col), "lang": text(lang_col), "source": text(source_col)}


def rules(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Counts, base_failed, failed and kept of every row; ``known`` are sketches of earlier runs
    to merge with this table's."""
    scratch = Scratch(docs.sparkSession, "rules")
    rows = scratch.write(facts(docs, _keep(docs, id_col, lang_col, source_col), text_col), "facts")
    own = sketch(rows)
    made = scratch.write(merge(own.unionByName(known) if known is not None else own, "lang", "source"), "sketch")
    limits = scratch.write(thresholds(made), "limits")
    scratch.drop("sketch")
    return judge(rows, limits)


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    blanks = "\\x20\\x09-\\x0D"
    stacked = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS measure, CASE WHEN {b} = 0 THEN 0 ELSE ({t} * {a}) // {b} END AS v, {int(below)} AS below, {least} AS least, {percent} AS percent FROM facts WHERE NOT base_failed" for m, (t, a, b, below, least, percent) in MEASURES.items())

    def level(name, keys):
        by = ", ".join([*keys, "measure"])
        return f"""{name}_c AS (SELECT {by}, bin, any_value(least) AS least, any_value(percent) AS percent, count(*) AS n FROM binned GROUP BY {by}, bin),
        {name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS docs FROM {name}_c),
        {name}_q AS (SELECT {by}, any_value(docs) AS docs, any_value(least) AS least, any_value(percent) AS percent,
            {', '.join(f"min(edge) FILTER (WHERE 4 * upto >= {k} * docs) AS q{k}" for k in (1, 2, 3))}
          FROM (SELECT *, CASE WHEN bin < {2 * BINS} THEN bin ELSE (bin - {BINS} * (bin // {BINS} - 1)) << (bin // {BINS} - 1) END AS edge FROM {name}_r) GROUP BY {by}),
        {name} AS (SELECT {by}, docs, q1 - {WIDTH} * greatest(q3 - q1, least, (percent * q2) // 100) AS low, q3 + {WIDTH} * greatest(q3 - q1, least, (percent * q2) // 100) AS high FROM {name}_q)"""

    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^{blanks}]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{blanks}]')) AS l FROM d),
    g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
    k AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g),
    p AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM k WHERE k > 1) GROUP BY r),
    facts AS (SELECT w.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED} * len(w)) AS base_failed FROM w LEFT JOIN p ON w.r = p.r),
    long AS ({stacked.replace('SELECT doc_id', 'SELECT r, doc_id')}),
    binned AS (SELECT *, {BINS} * greatest(length(bin(v)) - {BINS.bit_length()}, 0) + (v >> greatest(length(bin(v)) - {BINS.bit_length()}, 0)) AS bin FROM long),
    {level('grp', ['lang', 'source'])}, {level('lng', ['lang'])}, {level('every', [])},
    used AS (SELECT b.r, b.v, b.below, CASE WHEN g.docs >= {MIN_DOCS} THEN g.low WHEN l.docs >= {MIN_DOCS} THEN l.low ELSE e.low END AS low,
        CASE WHEN g.docs >= {MIN_DOCS} THEN g.high WHEN l.docs >= {MIN_DOCS} THEN l.high ELSE e.high END AS high
      FROM binned b JOIN grp g ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source AND b.measure = g.measure
      JOIN lng l ON b.lang IS NOT DISTINCT FROM l.lang AND b.measure = l.measure JOIN every e ON b.measure = e.measure),
    bad AS (SELECT r, count(*) FILTER (WHERE v > high OR (below = 1 AND v < low)) AS n FROM used GROUP BY r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(n, 0) = 0) AS kept FROM facts LEFT JOIN bad ON facts.r = bad.r"""
