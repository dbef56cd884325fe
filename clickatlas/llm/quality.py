"""Quality rules with thresholds learned from the corpus, by DataFrame functions alone.

Signals of each document are integers.  Their distribution in each (language,
source) is kept in a log-linear quantile sketch: bucket counts, where a bucket
spans 1 / ``2 ** BITS`` of its power of two.  Counts add up, so sketches merge by
``sum``: Spark combines them before the shuffle, sources merge to languages and
languages to the corpus, and the result does not depend on the order.  A quantile
is off by at most that fraction.

A document fails a rule if its signal lies beyond the fence of its group: a
multiple of the spread of the middle half away from it, and at least a stated
step.  Groups too small to tell take the fences of their language, and languages
those of the corpus.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted, work_dir

WHITE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Each power of two is cut into so many linear buckets, 2 ** BITS.
BITS = 5
#: A group with fewer documents takes the fences of the next wider one.
GROUP = 200
#: Fences of up to this many groups are broadcast, some 10 MB; else they are joined by shuffle.
BROADCAST_GROUPS = 50_000


class Rule(NamedTuple):
    """A signal with its fences: ``reach`` times the middle half's width, ``step`` at least; a side may be open."""

    signal: str
    reach: int
    step: int
    low: bool
    high: bool


RULES = (
    Rule("word_length", 10, 100, True, True),  # 1/100 code points a word
    Rule("symbols", 6, 100, False, True),  # a 1000 words
    Rule("dup_lines", 6, 400, False, True),  # a 1000 lines that have a word
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that occur twice in the array.

    Windows are compared by 64-bit hashes.  Sorted by (hash, place), a repeated
    one stands next to its equal; places in order then cover ``size`` words each,
    less what they overlap.
    """
    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-size).alias("last"))
        add = lambda a, p: F.struct((a["sum"] + F.least(F.lit(size), p - a["last"])).alias("sum"), p.alias("last"))
        return F.aggregate(places, start, add, lambda a: a["sum"])

    def repeats(s: Column) -> Column:
        twice = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        same = F.filter(s, lambda x, i: F.coalesce(twice(x, i), (F.get(s, i + 1)["h"] == x["h"]), F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
        return covered(F.array_sort(F.transform(same, lambda x: x["p"])))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - size)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def found(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_let(F.sort_array(pairs), repeats))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < size + 1, F.lit(0).cast("bigint")).otherwise(_let(_let(hashes, windows), found))


def signals(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, all long."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    both = F.struct(
        F.size("w").cast("bigint").alias("n_words"), repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("bigint").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
    )
    out = docs.withColumn("w", word_array(F.col("text"))).withColumn("l", lines).withColumn("s", both)
    return out.withColumns({
        "n_words": F.col("s.n_words"), "word_chars": F.length(F.translate(text, _BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": F.col("s.n_dup_lines"), "n_repeat_words": F.col("s.n_repeat_words"), "n_lines": F.col("s.n_lines"),
    }).drop("w", "l", "s")


def _measures() -> dict[str, Column]:
    """The rules' signals as whole numbers, rounded down; only for documents that have words."""
    return {
        "word_length": F.expr("word_chars * 100 div nullif(n_words, 0)"),
        "symbols": F.expr("n_symbols * 1000 div nullif(n_words, 0)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div nullif(n_lines, 0)"),
    }


def bucket(value: Column) -> Column:
    """Number of the sketch bucket of a whole number of 0 or more."""
    power = F.length(F.bin(value)) - 1
    shift = F.greatest(power - BITS, F.lit(0))
    return F.when(value < 2 << BITS, value).otherwise(shift.cast("bigint") * (1 << BITS) + F.call_function("shiftright", value, shift))


def bucket_value(b: Column) -> Column:
    """Smallest value of a bucket."""
    shift = F.greatest(F.call_function("shiftright", b, F.lit(BITS)) - 1, F.lit(0)).cast("int")
    return F.when(b < 2 << BITS, b).otherwise(F.call_function("shiftleft", b - shift.cast("bigint") * (1 << BITS), shift))


def sketch(measured: DataFrame) -> DataFrame:
    """Sketches (lang, source, signal, bucket, n) of the documents that have words."""
    each = F.explode(F.array(*[F.struct(F.lit(r.signal).alias("signal"), bucket(F.col(r.signal)).alias("bucket")) for r in RULES]))
    return measured.where("n_words > 0").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.signal", "x.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of each merged sketch, and its documents.

    A sketch has at most a few hundred buckets, whatever it counts: its array is
    bounded.
    """
    def at(share: int) -> Column:
        # the first bucket whose running count reaches the share
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("bucket"))
        step = lambda a, x: F.struct(
            (a["sum"] + x["n"]).alias("sum"), F.when(a["bucket"].isNull() & ((a["sum"] + x["n"]) * 4 >= F.col("docs") * share), x["bucket"]).otherwise(a["bucket"]).alias("bucket"))
        return F.aggregate("s", start, step, lambda a: bucket_value(a["bucket"]))

    merged = sketches.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))
    whole = merged.groupBy(*by, "signal").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("docs"))
    return whole.select(*by, "signal", "docs", at(1).alias("q1"), at(3).alias("q3"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row a (lang, source) of the sketches: struct ``fences`` with low and high bounds of each rule, null where open."""
    def bounds(q: DataFrame, by: list[str], name: str) -> DataFrame:
        cols = []
        for r in RULES:
            mine = F.col("signal") == r.signal
            reach = F.greatest((F.col("q3") - F.col("q1")) * r.reach, F.lit(r.step))
            cols += [F.max(F.when(mine, F.col("q1") - reach if r.low else F.lit(None))).cast("bigint").alias(f"{r.signal}_low"),
                     F.max(F.when(mine, F.col("q3") + reach if r.high else F.lit(None))).cast("bigint").alias(f"{r.signal}_high")]
        agg = q.groupBy(*by).agg(F.max("docs").alias("docs"), *cols)
        return agg.select(*by, F.struct("docs", *[f"{r.signal}_{s}" for r in RULES for s in ("low", "high")]).alias(name))

    own = bounds(_quantiles(sketches, ["lang", "source"]), ["lang", "source"], "own")
    langs = bounds(_quantiles(sketches, ["lang"]), ["lang"], "by_lang").withColumnRenamed("lang", "of_lang")
    # one row of a few numbers: the fences of the whole corpus
    corpus = bounds(_quantiles(sketches.withColumn("one", F.lit(1)), ["one"]), ["one"], "overall").first()
    j = own.join(langs, own["lang"].eqNullSafe(langs["of_lang"]), "left")
    names = [f.name for f in own.schema["own"].dataType]
    overall = F.struct(*[F.lit(corpus["overall"][n] if corpus else None).cast("bigint").alias(n) for n in names])
    pick = F.when(F.col("own.docs") >= GROUP, F.col("own")).when(F.col("by_lang.docs") >= GROUP, F.col("by_lang")).otherwise(overall)
    return j.select("lang", "source", pick.alias("fences"))


def verdicts(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` with ``failed_rules`` (names of the rules failed), base_failed and kept."""
    bounds, seen = cut_counted(bounds.withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), work_dir(measured.sparkSession), n=F.lit(1))
    side = F.broadcast(bounds) if seen["n"] <= BROADCAST_GROUPS else bounds
    j = measured.join(side, measured["lang"].eqNullSafe(F.col("g_lang")) & measured["source"].eqNullSafe(F.col("g_source")), "left")
    beyond = []
    for r in RULES:
        out = F.lit(False)
        if r.low:
            out = out | (F.col(r.signal) < F.col(f"fences.{r.signal}_low"))
        if r.high:
            out = out | (F.col(r.signal) > F.col(f"fences.{r.signal}_high"))
        beyond.append(F.when(out, r.signal))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return j.withColumn("failed_rules", F.array_compact(F.array(*beyond))).withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("g_lang", "g_source", "fences", *[r.signal for r in RULES])


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with signals and rule measures, written once: sketch and verdict both read it."""
    return cut(signals(docs).withColumns(_measures()))


def judge(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Verdict on every document: the columns of ``docs``, its signals, failed_rules, base_failed, kept.

    Needs ``text``, ``lang`` and ``source``; the text is left out of the result
    unless ``keep_text``.  Input columns that bear the name of an added one are
    dropped, other extra columns stay.

    A null text has no words, so it fails the base.  A null language or source is
    a group of its own.  Repeated rows count each time and get equal verdicts.
    Documents without words join no sketch and fail the base.  An empty table
    gives an empty table.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failed_rules", "base_failed", "kept", "g_lang", "g_source", "fences", "w", "l", "s", *[r.signal for r in RULES]}
    rows = docs.drop(*added)
    if not keep_text:
        measured = signals(rows).drop("text").withColumns(_measures())
        measured = cut(measured)
    else:
        measured = measure(rows)
    return verdicts(measured, fences(sketch(measured)))
