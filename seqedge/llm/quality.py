"""Quality rules (operator 7): repetition measures and cross-document line frequency, in DataFrame functions only.

A line is frequent in its host when more than ``max_docs`` documents of the host hold it. It is boilerplate when more than
``max_docs`` distinct ones do that have text of their own: documents of which frequent lines leave ``min_left`` percent of the
words, told apart by their longest line that is not frequent. So copies and near copies, whose lines are frequent because
the whole text is, neither lose their content nor count; judging them is the work of the near-duplicate join. Headers,
footers and site lines on different documents go, in blocks or between fixed neighbours alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.llm.common import WORD, cut, fresh, let, or_empty, quoted, table

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    """min_words, max_repeat: the base rules (words; percent of words in repeated windows). max_docs: a line of more
    distinct documents is boilerplate. min_left: percent of a document's words that must remain without boilerplate, and
    that frequent lines must leave for the document to count as one with text of its own."""

    min_words: int = 20
    max_repeat: int = 30
    window: int = 8
    max_docs: int = 20
    min_left: int = 30


def repeat_words(words: Column, window: int) -> Column:
    """Words that lie in ``window``-word windows found twice or more in the text (the first occurrence included).

    Windows are compared by a 64-bit hash. Texts without a repeated window, nearly all, stop at the distinct count;
    the others sort (hash, place) and add up what each repeated window covers beyond the next one's start.
    """

    def covered(places: Column) -> Column:
        follows = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.try_element_at(places, k + 2), p + window) - p))
        return F.aggregate(follows, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ranked: Column) -> Column:
        def same(k: Column, e: Column) -> Column:
            return F.coalesce(F.try_element_at(ranked, k)["h"] == e["h"], F.lit(False))

        hit = F.transform(ranked, lambda e, k: F.when((k > 0) & same(F.greatest(k, F.lit(1)), e) | same(k + 2, e), e["i"]))
        return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))

    def of(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(ranked, lambda r: let(places(r), covered)))

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(hashes, of))


def measures(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of the base measures of a text (null counts as empty)."""
    text = or_empty(text)

    def dup_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    return let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, dup_lines).alias("n_dup_lines"),
            repeat_words(w, limits.window).alias("n_repeat_words"),
        ),
    )


def normal_line(line: Column) -> Column:
    """A line as it is compared: digits and white space as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\s\d]+", " ")))


def line_structs(text: Column) -> Column:
    """The lines with a word as structs: h (hash of the normalised line), i (place among all lines), w (words), first (no
    equal line before it in the text)."""
    lines = F.transform(F.split(or_empty(text), "\n"), lambda x, k: F.struct(x.alias("x"), k.alias("i")))
    hashed = F.array_sort(F.transform(F.filter(lines, lambda e: e["x"].rlike(r"[^\x20\x09-\x0D]")), lambda e: F.struct(
        F.xxhash64(normal_line(e["x"])).alias("h"), e["i"].alias("i"), F.regexp_count(e["x"], F.lit(WORD)).alias("w"))))
    return let(hashed, lambda a: F.transform(a, lambda e, k: F.struct(
        e["h"].alias("h"), e["i"].alias("i"), e["w"].alias("w"), F.coalesce(F.get(a, k - 1)["h"] != e["h"], F.lit(True)).alias("first"))))


def measured(docs: DataFrame, text: str, host: str, limits: Limits, **more: Column) -> DataFrame:
    """(uid, host, m, lines) and ``more`` per row, written: every text is read once, and what follows works on numbers."""
    return cut(docs.select(F.monotonically_increasing_id().alias("uid"), or_empty(quoted(host).cast("string")).alias("host"),
                           measures(quoted(text), limits).alias("m"), line_structs(quoted(text)).alias("lines"),
                           *[c.alias(k) for k, c in more.items()]), "quality-rows")


def each_line(rows: DataFrame) -> DataFrame:
    return rows.select("uid", "host", F.explode("lines").alias("l")).select("uid", "host", "l.*")


def boilerplate(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, h) of each host's boilerplate lines, from ``measured`` rows. Counts combine in every task, so a line that a third of
    all documents hold is one row a task."""
    line = each_line(rows)
    frequent = cut(line.filter("first").groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > limits.max_docs).select("host", "h"), "frequent-lines")
    rare = F.col("f").isNull()
    own = (line.join(frequent.withColumn("f", F.lit(True)), ["host", "h"], "left").groupBy("uid")
           .agg(F.sum("w").alias("total"), F.sum(F.when(rare, F.col("w"))).alias("own"), F.max_by("h", F.when(rare, F.struct("w", -F.col("i")))).alias("sign"))
           .filter(100 * F.col("own") >= limits.min_left * F.col("total")).select("uid", "sign"))
    held = line.filter("first").join(frequent, ["host", "h"], "left_semi").select("uid", "host", "h").join(own, "uid")
    distinct = held.groupBy("host", "h", "sign").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n"))
    return cut(distinct.filter(F.col("n") > limits.max_docs).select("host", "h"), "boiler")


def verdict(m: Column, removed: Column, limits: Limits) -> tuple[Column, Column]:
    """(base_failed, depleted) from the measures and the words on boilerplate lines."""
    left = m["n_words"] - removed
    base_failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat * m["n_words"])
    depleted = (removed > 0) & ((left < limits.min_words) | (100 * left < limits.min_left * m["n_words"]))
    return base_failed, depleted


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Per input row: ``key``, the measures, n_boiler_words, base_failed, kept.

    A null text has no words and fails; a null host is a host of its own; repeated rows and equal or null keys are
    judged one by one; an empty table gives no rows; other columns, whatever their names, play no part.
    """
    rows = measured(docs, text, host, limits, key=quoted(key))
    removed = each_line(rows).join(boilerplate(rows, limits), ["host", "h"], "left_semi").groupBy("uid").agg(F.sum("w").cast("long").alias("n"))
    judged = rows.select("uid", "key", "m").join(removed, "uid", "left").withColumn("n_boiler_words", F.coalesce("n", F.lit(0).cast("long")))
    m = F.col("m")
    base_failed, depleted = verdict(m, F.col("n_boiler_words"), limits)
    return judged.select(F.col("key").alias(key), *[m[c].alias(c) for c in MEASURES], "n_boiler_words",
                         base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"))


def clean(docs: DataFrame, text: str = "text", host: str = "source", size: str | None = "n_chars", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with boilerplate lines taken out of their text (and ``size`` set to its new length).
    All columns of ``docs`` stay, whatever they are called; cases as in ``judge``.

    What a document loses depends on its host and text alone, so verdicts are found per (host, text id) from line
    hashes, and each text meets its own in one join; no text is repeated for each of its lines.
    """
    hst, tid, at, gone = fresh(docs, "host", "tid", "at", "gone")
    rows = measured(docs, text, host, limits, tid=F.md5(or_empty(quoted(text))))
    lost = each_line(rows).join(boilerplate(rows, limits), ["host", "h"], "left_semi").groupBy("uid").agg(F.collect_set("i").alias("at"), F.sum("w").alias("n"))
    base_failed, depleted = verdict(F.col("m"), F.coalesce("n", F.lit(0)), limits)
    stays = rows.select("uid", "host", "tid", "m").join(lost, "uid", "left").filter(~base_failed & ~depleted)
    # copies of a text have the same verdict
    stays = cut(stays.groupBy("host", "tid").agg(F.first("at").alias("at")), "verdicts").select(F.col("host").alias(hst), F.col("tid").alias(tid), F.col("at").alias(at))
    whole = docs.select("*", or_empty(quoted(host).cast("string")).alias(hst), F.md5(or_empty(quoted(text))).alias(tid))
    left = F.array_join(F.filter(F.split(quoted(text), "\n"), lambda x, k: ~F.array_contains(F.col(at), k)), "\n")
    kept = whole.join(stays, [hst, tid]).withColumn(gone, F.when(F.col(at).isNotNull(), left))

    def column(c: str) -> Column:
        if c == text:
            return F.coalesce(F.col(gone), quoted(c)).alias(c)
        return F.coalesce(F.length(gone), quoted(c)).cast(docs.schema[c].dataType).alias(c) if c == size else quoted(c)

    return kept.select(*[column(c) for c in docs.columns])


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


#: The same rows from DuckDB: measures by lists and windows, line counts by plain grouping.
ORACLE_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT uid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT uid, i, w[i:i+7] AS g FROM (SELECT uid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT uid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT uid, i, lead(i) OVER (PARTITION BY uid ORDER BY i) AS nxt FROM rep) GROUP BY uid),
ln AS (SELECT uid, host, i, l FROM (SELECT uid, host, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT uid, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY uid),
nl AS (SELECT uid, host, i, lower(trim(regexp_replace(l, '[\t\n\x0B\f\r 0-9]+', ' ', 'g'))) AS h, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM ln),
freq AS (SELECT host, h FROM nl GROUP BY host, h HAVING count(DISTINCT uid) > 20),
mk AS (SELECT nl.uid, nl.h, nl.i, nl.n, f.h IS NULL AS rare FROM nl LEFT JOIN freq f ON nl.host = f.host AND nl.h = f.h),
own AS (SELECT uid, arg_max(h, (n, -i)) FILTER (WHERE rare) AS sign FROM mk GROUP BY uid HAVING 100 * sum(n) FILTER (WHERE rare) >= 30 * sum(n)),
boiler AS (SELECT host, h FROM nl JOIN freq USING (host, h) JOIN own USING (uid) GROUP BY host, h HAVING count(DISTINCT sign) > 20),
gone AS (SELECT uid, sum(n)::BIGINT AS n_boiler_words FROM nl JOIN boiler USING (host, h) GROUP BY uid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_boiler_words, 0)::BIGINT AS n_boiler_words
      FROM w LEFT JOIN cov USING (uid) LEFT JOIN dup USING (uid) LEFT JOIN gone USING (uid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boiler_words, base_failed,
       NOT base_failed AND NOT (n_boiler_words > 0 AND (n_words - n_boiler_words < 20 OR 100 * (n_words - n_boiler_words) < 30 * n_words)) AS kept
FROM v
"""
