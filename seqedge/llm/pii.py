"""Personal data (operator 9): candidate gradient boosting, in DataFrame functions and Spark's own boosted trees.

High-recall patterns propose spans, which may overlap. Those that the base rules accept stay. The others, among them the
parts of what the base rules drop, are scored by boosted trees on their format and context, trained here on generated labelled spans; a threshold per kind, calibrated on a held-out part
for precision, selects which of them are redacted too.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqedge.llm.common import cut, let, or_empty, quoted, running, table

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. Possessive loops read the same spans as plain ones and need no stack on long runs; an address starts
#: where its run does, or where the last match ended, so a long run is read once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to have a span that can pass.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]"}
#: More proposals: written-out addresses, numbers in groups without a country code, long numbers in groups.
MORE = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|(?<=[^a-z0-9._%+-][._%+-]))[a-z0-9][a-z0-9._%+-]*+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[a-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]++)++",
    "card": r"(?<![0-9.+-])[0-9]{4}(?:[.\x20_/-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.)-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
MORE_NEEDS = r"(?i)\bat\b"  # of email
CONTEXT = {"phone": r"tel|phone|call|fax|mobil|dial|sms|ring", "email": r"mail|contact|write|reach|address|send", "card": r"card|visa|master|amex|pay|credit|debit"}
AROUND = 24
FEATURES = ["is_email", "is_card", "is_phone", "length", "digits", "letters", "separators", "kinds_of_separators", "brackets", "longest_digits", "groups",
            "luhn", "written_at", "written_dot", "ends_like_domain", "context_phone", "context_email", "context_card", "near_digit", "near_letter", "plus", "first_digits", "last_digits", "digits_after", "card_groups"]
#: Generated training spans, and the precision that the held-out quarter must show.
TRAIN_ROWS, PRECISION = 6000, 0.99


def spans(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, m>>: the pattern's leftmost matches that do not overlap, in code points. A match starts
    where the pieces between matches, and the matches before it, end."""

    def placed(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda p: F.length(p))
        sizes = F.zip_with(gaps, matches, lambda g, m: g + F.length(m))
        return let(gaps, lambda g: let(running(sizes), lambda at: F.transform(matches, lambda m, k: let(F.get(at, k) + F.get(g, k), lambda s: F.struct(
            s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m"))))))

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    there = text.contains(needs) if needs == "@" else text.rlike(needs)
    return F.when(there, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def every_span(text: Column, pattern: str) -> Column:
    """As ``spans``, but with the match at every place where one starts, also inside another match."""

    def placed(matches: Column) -> Column:
        gaps = F.transform(F.split(text, f"(?={pattern})", -1), lambda p: F.length(p))  # no empty piece before a match at the start

        def of(g: Column) -> Column:
            skip = F.size(g) - F.size(matches)
            first = F.when(skip > 0, F.get(g, F.lit(0))).otherwise(0)
            return let(first, lambda f: let(running(F.slice(g, skip + 1, F.size(matches))), lambda at: F.transform(matches, lambda m, k: F.struct(
                (f + F.get(at, k)).alias("start"), (f + F.get(at, k) + F.length(m)).alias("end"), m.alias("m")))))

        return let(gaps, of)

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)), placed)).otherwise(none)


def parts(kind: str, x: Column) -> Column:
    """What a base match that fails may hold, as spans that may overlap: in a card match every run of 16 to 19 digits from
    one separator to another, in a phone match the number cut after each group of digits that gives it 8 to 15."""
    def found(m: Column, start: Column, pattern: str, sizes: range) -> Column:
        runs = F.filter(F.array(*[F.regexp_extract(m, pattern % (n - 1), 0) for n in sizes]), lambda r: r != "")
        return F.transform(runs, lambda r: F.struct(start.alias("start"), (start + F.length(r)).alias("end"), r.alias("m")))

    if kind == "phone":
        return found(x["m"], x["start"], r"^\+(?:[0-9][\x20().-]*+){%d}[0-9](?![0-9])", range(8, 16))

    def of(chars: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | F.get(chars, F.greatest(i - 1, F.lit(0))).isin(" ", "-"))
        # 19 digits, a separator between any two, and one character to see where the last group ends
        return F.flatten(F.transform(starts, lambda i: let(F.array_join(F.slice(chars, i + 1, 38), ""),
                                                           lambda m: found(m, x["start"] + i, r"^(?:[0-9][\x20-]?){%d}[0-9](?![0-9])", range(16, 20)))))

    return let(F.split(x["m"], ""), of)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0, F.lit(False))


def passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    size = F.length(digits_of(m))
    return size.between(16, 19) & luhn(digits_of(m)) if kind == "card" else size.between(8, 15)


def features(kind: Column, m: Column, before: Column, after: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(m, F.lit(p))
    low = F.lower(before)
    out = {f"is_{k}": kind == k for k in ("email", "card", "phone")} | {
        "length": F.length(m), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "separators": count(r"[\x20._/-]"),
        "kinds_of_separators": reduce(lambda a, b: a + b, [m.contains(c).cast("int") for c in " ._/-"]), "brackets": count(r"[()\[\]]"),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)),
        "groups": count("[0-9]+"), "luhn": luhn(digits_of(m)), "written_at": m.rlike(r"(?i)[\[(]at[\])]"), "written_dot": m.rlike(r"(?i)[\[(]dot[\])]|\x20dot\x20"),
        "ends_like_domain": m.rlike(r"(?i)[.\x20\])](com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"),
        "near_digit": after.rlike("^[0-9]") | before.rlike(r"[0-9][\x20.,/-]?$"), "near_letter": after.rlike("^[A-Za-z]") | before.rlike("[A-Za-z]$"),
        "plus": m.startswith("+"), "first_digits": F.length(F.regexp_extract(m, "[0-9]+", 0)), "last_digits": F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)),
        "card_groups": m.rlike("^[0-9]{16,19}$|^[0-9]{4}(?:[^0-9][0-9]{4}){3}(?:[^0-9][0-9]{1,3})?$"), "digits_after": F.length(F.regexp_extract(after, r"^[\x20().-]{1,2}([0-9]+)", 1)),
    } | {f"context_{k}": low.rlike(p) for k, p in CONTEXT.items()}
    return {k: F.coalesce(out[k].cast("double"), F.lit(0.0)) for k in FEATURES}


def training_spans(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 3) -> DataFrame:
    """(kind, m, before, after, label): spans in formats that are personal data, and in look-alike formats that are not
    (dates, years, measures, versions, serial numbers, prose), with random digits and words and mixed contexts."""
    i = F.col("id")
    pick = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(n))
    num = lambda salt, n: F.lpad(pick(salt, 10**n).cast("string"), n, "0")
    word = lambda salt: F.element_at(F.array(*[F.lit(w) for w in "anna miller jo shop alpha kurt info lena office river stone maple".split()]), (pick(salt, 12) + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(w) for w in ("com", "org", "net", "de", "fr")]), (pick("top", 5) + 1).cast("int"))
    cat = F.concat
    fifteen = cat(num("c1", 8), num("c2", 7))
    check = let(F.aggregate(F.transform(F.split(F.reverse(fifteen), ""), lambda c, k: let(c.try_cast("int") * F.when(k % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))),
                            F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), lambda s: ((10 - s % 10) % 10).cast("string"))
    card = cat(fifteen, check)
    grouped = lambda d, sep: F.concat_ws(sep, *[F.substring(d, 4 * j + 1, 4) for j in range(4)])
    serial = cat(num("s1", 8), num("s2", 8))
    good_words, plain_words = "phone: |call us at |tel. |mail me: |write to |contact |card no |pay with visa |", "in the year |version |chapter |size |between |the total of |see page |"
    beside = "12 |555-3296 |4845168114407329 |a list of 17 |"
    spaced = cat(F.lit("+"), num(1, 2), F.lit(" "), num(2, 2), F.lit(" "), num(3, 4))
    bracketed = cat(F.lit("+"), num(1, 1), F.lit(" ("), num(2, 3), F.lit(") "), num(3, 3), F.lit("-"), num(4, 4))
    dashed = cat(F.lit("+"), num(1, 1), F.lit("-"), num(2, 3), F.lit("-"), num(3, 3), F.lit("-"), num(4, 4))
    local = cat(F.lit("+"), num(1, 2), F.lit(" "), num(2, 3), F.lit(" "), num(3, 7))
    numbers = [cat(F.lit(" "), num("a1", 3), F.lit("."), num("a2", 3)), cat(F.lit(" "), num("a3", 8)), cat(F.lit(" "), num("a4", 2)), F.lit(", "), F.lit(" and"), F.lit(".")]
    four = [cat(F.lit(" "), num("a5", 4)), cat(F.lit(" "), num("a6", 4), F.lit(" 19"))]
    forms = [  # kind, span, label, context words, what may follow (else as everywhere)
        ("phone", cat(F.lit("("), num(1, 3), F.lit(") "), num(2, 3), F.lit("-"), num(3, 4)), 1, good_words + plain_words),
        ("phone", cat(num(1, 3), F.lit("-"), num(2, 3), F.lit("-"), num(3, 4)), 1, good_words + plain_words),
        ("phone", cat(num(1, 3), F.lit("."), num(2, 3), F.lit("."), num(3, 4)), 1, good_words),
        ("phone", cat(num(1, 3), F.lit(" "), num(2, 3), F.lit(" "), num(3, 4)), 1, good_words.rstrip("|")),
        ("email", cat(word(1), F.lit(" [at] "), word(2), F.lit(" [dot] "), top), 1, good_words + plain_words),
        ("email", cat(word(1), F.lit("(at)"), word(2), F.lit("."), top), 1, good_words + plain_words),
        ("email", cat(word(1), F.lit(" at "), word(2), F.lit(" dot "), top), 1, good_words + plain_words),
        ("card", grouped(card, "."), 1, good_words + plain_words),
        ("card", grouped(card, "_"), 1, good_words + plain_words),
        ("phone", cat(F.lit("20"), num(1, 2), F.lit("-"), num(2, 3), F.lit("-"), num(3, 3)), 0, plain_words),
        ("phone", cat(F.lit("19"), num(1, 2), F.lit(" "), F.lit("19"), num(2, 2), F.lit(" 20"), num(3, 2)), 0, plain_words),
        ("phone", cat(num(1, 3), F.lit(" "), num(2, 3), F.lit(" "), num(3, 3)), 0, plain_words),
        ("phone", cat(num(1, 2), F.lit("."), num(2, 3), F.lit("."), num(3, 3)), 0, plain_words),
        ("phone", cat(num(1, 4), F.lit(" "), num(2, 4), F.lit(" "), num(3, 4)), 0, plain_words),
        ("email", cat(word(1), F.lit(" at "), word(2), F.lit("."), word(3)), 0, good_words + plain_words),
        ("email", cat(word(1), F.lit(" at "), num(2, 1), F.lit("."), num(3, 2)), 0, plain_words),
        ("card", grouped(serial, "."), 0, plain_words),
        ("card", grouped(serial, "-"), 0, plain_words),
        ("card", grouped(serial, " "), 0, plain_words),
        *[("phone", m, 1, good_words + plain_words, numbers) for m in (bracketed, dashed, local, cat(spaced, F.lit(" "), num(4, 4)))],
        *[("phone", cat(m, F.lit(sep), num(5, n)), 0, good_words + plain_words, numbers) for m in (bracketed, dashed) for sep, n in ((" ", 3), (" ", 2))],
        ("phone", cat(local, F.lit(" "), num(5, 2)), 0, good_words + plain_words, numbers),
        ("phone", spaced, 0, good_words + plain_words, four),
        *[("card", m, 1, good_words + plain_words + beside, numbers) for m in (card, grouped(card, " "), grouped(card, "-"))],
        *[("card", m, 0, good_words + plain_words + beside, numbers) for m in (serial, grouped(serial, " "))],
        # other numbers side by side whose digits pass the check by chance
        *[("card", F.concat_ws(" ", *[F.substring(card, a + 1, b - a) for a, b in zip(at, at[1:])]), 0, plain_words + beside, numbers)
          for at in (range(17), range(0, 17, 2), (0, 3, 6, 9, 12, 15, 16), (0, 1, 3, 6, 8, 9, 12, 14, 16), (0, 3, 7, 10, 13, 16), (0, 4, 7, 10, 16), (0, 2, 16), (0, 13, 16))],
    ]
    form = pick("form", len(forms))
    chosen = lambda make: reduce(lambda rest, k: F.when(form == k, make(*forms[k])).otherwise(rest), range(1, len(forms)), make(*forms[0]))

    def context(words: str) -> Column:
        options = [w for w in words.split("|")]
        return F.element_at(F.array(*[F.lit(w) for w in options]), (pick("context", len(options)) + 1).cast("int"))

    def follows(options: list[Column]) -> Column:
        return F.element_at(F.array(*options), (pick("after", len(options)) + 1).cast("int"))

    plain = [F.lit(w) for w in ("", ".", " and", ", ", "\n")]
    # serial numbers pass the check by chance one time in ten; those are not negatives, other layouts are
    out = spark.range(rows).select("id", chosen(lambda k, m, y, c, a=plain: F.lit(k)).alias("kind"), chosen(lambda k, m, y, c, a=plain: m).alias("m"),
                                   chosen(lambda k, m, y, c, a=plain: context(c)).alias("before"), 
                                   chosen(lambda k, m, y, c, a=plain: follows(a)).alias("after"), chosen(lambda k, m, y, c, a=plain: F.lit(float(y))).alias("label"))
    return out.filter((F.col("kind") != "card") | (F.col("label") == 1) | ~luhn(digits_of(F.col("m"))) | ~F.col("m").rlike("^[0-9]{4}(.?[0-9]{4}){3}$"))


def train(spark: SparkSession):
    """(model, thresholds by kind): boosted trees on three quarters of the spans. A kind's threshold is the least score
    from which on the held-out quarter reaches PRECISION; 1.01 (no span) where none does."""
    rows = training_spans(spark)
    rows = cut(rows.select("id", "kind", "label", *[c.alias(k) for k, c in features(F.col("kind"), F.col("m"), F.col("before"), F.col("after")).items()]), "pii-train")
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0
    model = GBTClassifier(maxIter=12, maxDepth=4, seed=5, labelCol="label").fit(assembled.filter(~held))
    scored = model.transform(assembled.filter(held)).select("kind", "label", F.round(vector_to_array("probability")[1], 2).alias("p"))
    grid = scored.groupBy("kind", "p").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()  # 100 scores a kind at most
    thresholds = {}
    for kind in CONTEXT:
        mine, n, y, best = sorted([r for r in grid if r["kind"] == kind], key=lambda r: -r["p"]), 0, 0, 1.01
        for r in mine:
            n, y = n + r["n"], y + r["y"]
            if y >= PRECISION * n:
                best = r["p"]
        thresholds[kind] = max(0.5, best)
    return model, thresholds


def contexts(text: Column, found: Column) -> Column:
    """The proposals with the AROUND code points before them and the 8 after, each cut out of two blocks of the text
    rather than out of the whole of it."""
    size = 1024

    def of(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            b = F.floor(start / size).cast("int")
            return F.substring(F.concat(F.coalesce(F.get(blocks, b), F.lit("")), F.coalesce(F.get(blocks, b + 1), F.lit(""))), start - b * size + 1, end - start)

        return F.transform(found, lambda x: F.struct(
            x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"),
            piece(F.greatest(F.lit(0), x["start"] - AROUND), x["start"]).alias("before"), piece(x["end"], x["end"] + 8).alias("after")))

    none = F.array().cast("array<struct<k:int,start:int,end:int,m:string,before:string,after:string>>")
    return F.when(F.size(found) == 0, none).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), of))


def free(proposed: DataFrame, base: DataFrame) -> DataFrame:
    """The proposals that touch no base span of their text: in the order of places, where the proposals' ends come before
    base starts, no base span seen so far may end beyond the proposal's start."""
    events = proposed.select("uid", "x", F.col("x.end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("upto")).unionByName(
        base.select("uid", F.col("b.start").alias("at"), F.lit(1).alias("kind"), F.col("b.end").alias("upto")), allowMissingColumns=True)
    seen = F.max("upto").over(Window.partitionBy("uid").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("seen", seen).filter((F.col("kind") == 0) & (F.col("seen").isNull() | (F.col("seen") <= F.col("x.start")))).select("uid", "x").distinct()


def apart(chosen: DataFrame) -> DataFrame:
    """(uid, more): of the chosen spans (uid, p, k, start, end, m) that overlap, the one with the highest score, of equals the
    longest, then by kind and place. Spans that are not linked by overlaps are judged apart."""
    in_text = Window.partitionBy("uid").orderBy("start", "end", "k")
    before = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = chosen.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1))
    linked = opens.withColumn("chain", F.sum("new").over(in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kind = "array<struct<k:int,start:int,end:int,m:string>>"
    best = lambda a, x: F.when(F.exists(a, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), a).otherwise(
        F.concat(a, F.array(F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"))))).cast(kind)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), (F.col("start") - F.col("end")).alias("l"), "k", "start", "end", "m")))
    kept = linked.groupBy("uid", "chain").agg(F.aggregate(ranked, F.array().cast(kind), best).alias("some"))
    return kept.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("more"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, base, more) per input row: arrays of (kind number, start, end, m) of the base spans, and of the proposals
    that the trees select and that touch no base span; both in the order of kind, then start. Of selected proposals that
    overlap, the one with the highest score stays, of equals the longest. ``with_text`` adds the text as t (null as empty).

    Null and empty texts have no spans; repeated rows and equal or null keys are searched one by one; an empty table
    gives no rows; other columns play no part. Long runs of one kind of character and texts of many spans cost as much
    as their length; spans of a text meet in one task.
    """
    model, thresholds = train(docs.sparkSession)
    t = F.col("t")
    matched = lambda kind: let(spans(t, BASE[kind], NEEDS[kind]), lambda a: F.struct(
        F.filter(a, lambda x: passes(kind, x["m"])).alias("kept"), F.filter(a, lambda x: ~passes(kind, x["m"])).alias("failed")))
    numbered = lambda kind, a: F.transform(a, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m")))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), quoted(key).alias("key"), or_empty(quoted(text)).alias("t"))
    rows = rows.withColumn("found", let(F.struct(*[matched(k).alias(k) for k in KINDS]), lambda a: F.struct(
        F.concat(*[numbered(k, a[k]["kept"]) for k in KINDS]).alias("base"),
        F.concat(*[numbered(k, F.flatten(F.transform(a[k]["failed"], partial(parts, k)))) for k in ("card", "phone")]).alias("parts"))))
    more = [numbered(k, every_span(t, MORE[k]) if k != "email" else spans(t, MORE[k], MORE_NEEDS)) for k in MORE]
    proposals = let(F.concat(*more, F.col("found.parts")), lambda a: contexts(t, a))
    carried = ["key", "base", *(["t"] if with_text else [])]
    rows = cut(rows.select("uid", F.col("found.base").alias("base"), "key", *carried[2:], proposals.alias("proposals")), "pii-spans")
    one = free(rows.select("uid", F.explode("proposals").alias("x")), rows.select("uid", F.explode("base").alias("b")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("x.k") + 1)
    one = one.select("uid", "x", kind.alias("kind"), *[c.alias(k) for k, c in features(kind, F.col("x.m"), F.col("x.before"), F.col("x.after")).items()])
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(one)).withColumn("p", vector_to_array("probability")[1])
    least = reduce(lambda rest, k: F.when(F.col("kind") == k, F.lit(thresholds[k])).otherwise(rest), thresholds, F.lit(2.0))
    selected = apart(scored.filter(F.col("p") >= least).select("uid", "p", "x.k", "x.start", "x.end", "x.m"))
    none = F.array().cast("array<struct<k:int,start:int,end:int,m:string>>")
    return rows.drop("proposals").join(selected, "uid", "left").select(F.col("key").alias(key), "base", F.coalesce("more", none).alias("more"), *carried[2:])


def joined(a: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every selected span replaced by its kind in brackets, from the end of the text backwards; of two
    spans that overlap, the earlier one is cut where the later one starts. Other cases as in ``find``."""
    found = find(docs, key, text, with_text=True)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    backwards = F.reverse(F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k")))))
    step = lambda a, x: F.struct(
        F.concat(F.element_at(names, x["k"] + 1),
                 F.substring(F.col("t"), F.least(x["end"], a["upto"]) + 1, a["upto"] - F.least(x["end"], a["upto"])), a["out"]).alias("out"), x["start"].alias("upto"))
    done = F.aggregate(backwards, F.struct(F.lit("").alias("out"), F.length("t").alias("upto")), step)
    return found.select(quoted(key), let(done, lambda a: F.concat(F.substring(F.col("t"), F.lit(1), a["upto"]), a["out"])).alias(text))


def op9_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = F.transform("base", lambda x: x["k"])
    counts = [(F.size(of_kind) - F.size(F.array_remove(of_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "more"))).alias("spans"))
