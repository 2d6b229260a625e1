"""Quality rules whose limits come from the corpus itself.

Each document's surface figures are counted with SQL functions alone. The limits
of its (language, source) are read off quantile sketches, which merge by adding
counts, so any partition, run or increment can be added to another and gives the
same limits. A sketch counts values in bins whose width is a sixteenth of the
power of two they lie in, so a quantile is off by 1/16 of itself at most.

A metric is a rate, with half a hit and one place added: so a short text without
hits has a higher one than a long text, and a metric that most texts have no hit
of still spreads. A document is out if it lies more than ``RANGES`` interquartile
ranges beyond the quartiles. No limit is fixed: where a group is too small to tell,
the limits of its language, and those of all documents, weigh in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stash, text_or_empty

#: metric: (hits, places)
METRICS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: Limits lie so many interquartile ranges beyond the quartiles; a range counts as one bin at least, as a sketch can't see less.
RANGES = 3
#: Only this metric has a lower limit too.
LOW = "word_length"
#: The limits of the next coarser level count as much as those of so many documents.
PRIOR = 50
BLANK_CLASS = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def base_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    Null text counts as empty, all figures 0 and base_failed true. Input columns
    with these names are replaced. Word triples are compared by a 64-bit hash.
    """
    t = F.col("__text")
    df = docs.withColumn("__text", text_or_empty(text))
    df = df.withColumn("__words", F.array_remove(F.split(t, BLANK_CLASS), "")).withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(WORD))))
    n = F.size("__words")
    words = F.col("__words")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__h": F.transform(words, lambda w: F.xxhash64(w)),
    })
    df = df.drop("__text", "__lines", "__words") if text != "__text" else df
    h = F.col("__h")
    df = df.withColumn("__h", F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2])))
    # Most texts have no triple twice, which one pass over plain numbers tells.
    df = df.withColumn("n_repeat_words", F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(h)).otherwise(0).cast("long")).drop("__h")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _repeated(h: Column) -> Column:
    """Words covered by triples whose hash is found twice or more."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def places(s: Column) -> Column:
        """Ascending places of the triples that have an equal neighbour in the order of their hashes."""
        equal = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: equal(i, i - 1) | equal(i, i + 1))
        return F.array_sort(F.transform(twice, lambda x: x["p"]))

    # Each triple adds the words that the one before it, at most two places away, hasn't covered.
    added = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), x - 3)))
    return F.aggregate(let(let(ranked, places), added), F.lit(0), lambda acc, x: acc + x)


def bin_of(metric: str) -> Column:
    hits, places = METRICS[metric]
    v = f"greatest((2 * {hits} + 1) * 1048576 div (2 * {places} + 2), 1)"
    e = f"(length(bin({v})) - 1)"
    return F.expr(f"cast({e} * 16 + if({e} >= 4, shiftright({v}, {e} - 4), shiftleft({v}, 4 - {e})) - 16 as int)")


def sketch(figures: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketches: (by, metric, bin, n) over the documents that pass the base rules."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(m).alias("bin")) for m in METRICS])).alias("__x")
    return figures.where(~F.col("base_failed")).select(*by, rows).select(*by, "__x.metric", "__x.bin").groupBy(*by, "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Add up sketches, over any coarser ``by`` too."""
    return sketches.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: its document count n_docs and, per metric, the bounds of accepted bins."""
    w = Window.partitionBy(*by, "metric").orderBy("bin")
    cum = sketches.withColumn("__cum", F.sum("n").over(w)).withColumn("__all", F.sum("n").over(Window.partitionBy(*by, "metric")))
    at = lambda q: F.min(F.when(4 * F.col("__cum") >= q * F.col("__all"), F.col("bin")))
    q = cum.groupBy(*by, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("__all").alias("n"))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, c)).cast("long")
    spread = RANGES * F.greatest(F.col("q3") - F.col("q1"), F.lit(1))
    out = [pick(m, F.col("q3") + spread).alias(f"hi_{m}") for m in METRICS]
    return q.groupBy(*by).agg(F.max("n").alias("n_docs"), *out, pick(LOW, F.greatest(F.col("q1") - spread, F.lit(0))).alias(f"lo_{LOW}"))


BOUNDS = [f"hi_{m}" for m in METRICS] + [f"lo_{LOW}"]


def _weighed(own: str, coarser: str) -> Column:
    """A level's limits and those of the next, by their documents."""
    n = F.col(f"{own}.n_docs")
    return F.struct(*[F.expr(f"({own}.n_docs * {own}.{b} + {PRIOR} * {coarser}.{b}) div ({own}.n_docs + {PRIOR})").alias(b) for b in BOUNDS], n.alias("n_docs"))


def quality_rules(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Judge every document by the limits of its language and source.

    Returns the columns ``keep`` (by default all but ``text``), the base figures,
    base_failed, and kept: false for a document that fails the base rules, else
    whether each metric lies within the limits of its group. Input columns with
    the added names are replaced. Null languages and
    sources are groups of their own. Rows repeat as they do in the input; an
    empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c != "kept"]
    figures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = base_figures(docs.withColumns({"__lang": F.col(lang), "__source": F.col(source)}), text)
    stash = Stash(docs.sparkSession, "quality-rules")
    counted = stash.keep(counted.select(*[c for c in keep if c not in figures], "__lang", "__source", *figures), "figures")
    fine = stash.keep(sketch(counted, ["__lang", "__source"]), "sketches")

    def named(level: str, by: list[str]) -> DataFrame:
        found = limits(fine if len(by) == 2 else merge(fine, by), by) if by else limits(merge(fine.withColumn("__one", F.lit(1)), ["__one"]), ["__one"])
        return found.select(*[F.col(c).alias(f"{level}{c}") for c in by], F.struct("n_docs", *BOUNDS).alias(f"__{level}"))

    g, l, a = named("g", ["__lang", "__source"]), named("l", ["__lang"]), named("a", [])
    groups = g.join(l, F.col("g__lang").eqNullSafe(F.col("l__lang")), "left").crossJoin(F.broadcast(a))  # a has one row
    groups = groups.withColumn("__l", _weighed("__l", "__a")).select("g__lang", "g__source", _weighed("__g", "__l").alias("__limit"))
    judged = counted.join(groups, F.col("__lang").eqNullSafe(F.col("g__lang")) & F.col("__source").eqNullSafe(F.col("g__source")), "left")
    within = [bin_of(m) <= F.col(f"__limit.hi_{m}") for m in METRICS] + [bin_of(LOW) >= F.col(f"__limit.lo_{LOW}")]
    verdict = ~F.col("base_failed") & F.coalesce(reduce(lambda x, y: x & y, within), F.lit(False))
    return judged.select(*[c for c in keep if c not in figures], *figures, verdict.alias("kept"))


def op10_sql() -> str:
    """The same over DuckDB."""
    bits = lambda v: f"(length(bin({v})) - 1)"
    value = lambda m: f"greatest((2 * {METRICS[m][0]} + 1) * 1048576 // (2 * {METRICS[m][1]} + 2), 1)"
    binned = lambda v: f"({bits(v)} * 16 + CASE WHEN {bits(v)} >= 4 THEN {v} >> ({bits(v)} - 4) ELSE {v} << (4 - {bits(v)}) END - 16)"
    metric = lambda m: binned(value(m))
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {metric(m)} AS bin FROM f WHERE NOT base_failed" for m in METRICS)
    spread = f"{RANGES} * greatest(q3 - q1, 1)"

    def level(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        cut = ", ".join(f"max(q3 + {spread}) FILTER (metric = '{m}') AS hi_{m}" for m in METRICS)
        return f"""
        {name}_c AS (SELECT {keys}metric, bin, sum(count(*)) OVER (PARTITION BY {keys}metric ORDER BY bin) AS cum, sum(count(*)) OVER (PARTITION BY {keys}metric) AS total FROM m GROUP BY {keys}metric, bin),
        {name}_q AS (SELECT {keys}metric, min(bin) FILTER (4 * cum >= total) AS q1, min(bin) FILTER (4 * cum >= 3 * total) AS q3, max(total)::BIGINT AS n FROM {name}_c GROUP BY {keys}metric),
        {name} AS (SELECT {keys}max(n) AS n_docs, {cut}, max(greatest(q1 - {spread}, 0)) FILTER (metric = '{LOW}') AS lo_{LOW} FROM {name}_q {"GROUP BY " + by if by else ""})"""

    weighed = lambda own, n, coarser: f"({n} * {own} + {PRIOR} * {coarser}) // ({n} + {PRIOR})"
    choose = lambda c: weighed(f"g.{c}", "g.n_docs", f"({weighed(f'l.{c}', 'l.n_docs', f'a.{c}')})")
    within = " AND ".join([f"{metric(m)} <= {choose(f'hi_{m}')}" for m in METRICS] + [f"{metric(LOW)} >= {choose(f'lo_{LOW}')}"])
    return f"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
    three AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    again AS (SELECT doc_id, i FROM three QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    f0 AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f0),
    m AS ({rows}),
    {level("g", "lang, source")}, {level("l", "lang")}, {level("a", "")}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, false) AS kept
    FROM f LEFT JOIN g ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source LEFT JOIN l ON f.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""
