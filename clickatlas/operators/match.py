"""Which triggers answer which goals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels
from ..session import FEW_ROWS, few
from .rows import spread, top_n

#: Questions of a host up to which each of its labels is asked for every one of them.
FEW_QUESTIONS = 8


def label_tokens(label) -> "F.Column":
    return F.array_distinct(labels.words(label))


def match_goals(questions: DataFrame, triggers: DataFrame) -> DataFrame:
    """(q_id, host, trig_seq, needle_hit) for every trigger a question selects.

    A goal with nouns selects the labels that hold one of them as a whole word,
    with an optional plural ending.  Nouns and label words meet in an equi-join
    on (host, word), so the cost follows the matches and not questions times
    triggers.  A goal without nouns asks for any goal verb, and ``match`` is a
    regular expression over the label; both test the pattern in the join
    condition, and a host's labels are spread over salts.

    The questions of hosts that ask few are sent to the triggers instead, which are
    read once and not shuffled.
    """
    q = few(questions.select("q_id", "host", "goal", "match"))
    t = triggers.select("host", "trig_seq", "label")
    per = q.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("q_id").alias("ids"))
    most = per.agg(F.max("n"), F.sum("n"), F.bool_and(F.col("n") == F.col("ids"))).first()
    if most[2] and most[0] <= FEW_QUESTIONS and most[1] <= FEW_ROWS:
        return _asked_of_each(q, t)
    # a site repeats its labels: patterns are tested once per label, not once per trigger
    lab = t.select("host", "label").distinct()
    has_match = F.coalesce("match", F.lit("")) != ""

    asked = q.where(F.coalesce("goal", F.lit("")) != "").withColumn("nouns", labels.goal_nouns("goal"))
    # the verb-near-noun test decides only the order among equally near routes
    pattern = F.when(~has_match, labels.goal_needle(F.col("nouns")))
    by_word = asked.where(F.size("nouns") > 0).select(
        "q_id", "host", pattern.alias("needle"),
        F.explode(F.array_distinct(F.flatten(F.transform("nouns", labels.noun_forms)))).alias("word"),
    )
    words = lab.select("host", "label", F.explode(label_tokens("label")).alias("word"))
    by_noun = by_word.join(words, ["host", "word"]).select(
        "q_id", "host", "label", F.coalesce(F.rlike("label", F.col("needle")), F.lit(False)).alias("needle_hit")
    )
    bare, doing = spread(asked.where((F.size("nouns") == 0) & ~has_match).select("q_id", "host"), lab.where(F.col("label").rlike(labels.GOAL_VERB_PATTERN)), ["label"])
    verbs = bare.join(doing, ["host", "_salt"]).select("q_id", "host", "label", F.lit(True).alias("needle_hit"))
    rx, texts = spread(q.where(has_match).select("q_id", "host", F.concat(F.lit("(?iuU)"), F.col("match")).alias("rx")), lab, ["label"])
    patterns = (
        rx.alias("q").join(texts.alias("t"), (F.col("q.host") == F.col("t.host")) & (F.col("q._salt") == F.col("t._salt")) & F.rlike("t.label", F.col("q.rx")))
        .select("q.q_id", "q.host", "t.label", F.lit(True).alias("needle_hit"))
    )
    hits = by_noun.unionByName(verbs).unionByName(patterns).groupBy("q_id", "host", "label").agg(
        F.max("needle_hit").alias("needle_hit")
    )
    return hits.join(t, ["host", "label"]).select("q_id", "host", "trig_seq", "needle_hit")


def _asked_of_each(q: DataFrame, t: DataFrame) -> DataFrame:
    """:func:`match_goals` for few questions, each with a ``q_id`` of its own."""
    goal, match = F.coalesce("goal", F.lit("")), F.coalesce("match", F.lit(""))
    asked = q.withColumn("nouns", F.when(goal != "", labels.goal_nouns("goal"))).select(
        "q_id", "host", F.array_distinct(F.flatten(F.transform("nouns", labels.noun_forms))).alias("forms"),
        F.when((F.size("nouns") > 0) & (match == ""), labels.goal_needle(F.col("nouns"))).alias("needle"),
        ((F.size("nouns") == 0) & (match == "")).alias("bare"), F.when(match != "", F.concat(F.lit("(?iuU)"), F.col("match"))).alias("rx"),
    )
    words = t.select("host", "trig_seq", "label", label_tokens("label").alias("words"), F.col("label").rlike(labels.GOAL_VERB_PATTERN).alias("doing"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    named, other = yes(F.arrays_overlap("forms", "words")), yes(F.col("bare") & F.col("doing")) | yes(F.rlike("label", F.col("rx")))
    return words.join(asked, "host").where(named | other).select("q_id", "host", "trig_seq", (other | (named & yes(F.rlike("label", F.col("needle"))))).alias("needle_hit"))


def find_trigger_pages(edges: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """Recorded actions whose label fits ``pattern``, with the page they are on."""
    hits = edges.where(F.coalesce("label", F.lit("")).rlike("(?iuU)" + pattern))
    pages = nodes.select("host", F.col("id").alias("src"), "url")
    return hits.join(pages, ["host", "src"], "left").select(
        "host", "edge_seq", "label", F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("src")).alias("url")
    )


def closeness(a, b) -> "F.Column":
    """Similarity of two strings, 0 to 1: the share of the longer one that no edit touches."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def suggest_labels(needles: DataFrame, triggers: DataFrame, n: int = K.MAX_SUGGESTIONS) -> DataFrame:
    """Up to ``n`` labels of the host for each (host, needle).

    Labels that share a stemmed word come first, in trigger order: an equi-join
    on (host, word).  Only needles without any such label look for the closest
    ones, by edit distance; labels too short or too long to reach the cutoff are
    ruled out in the join condition, before any text is compared.
    """
    known = triggers.where(F.trim(F.coalesce("label", F.lit(""))) != "")
    distinct = known.groupBy("host", "label").agg(F.min("trig_seq").alias("trig_seq"))
    want = needles.select("host", "needle").distinct()
    wt = want.select("host", "needle", F.explode(labels.stem_tokens("needle")).alias("w"))
    lt = distinct.select("host", "label", "trig_seq", F.explode(labels.stem_tokens("label")).alias("w"))
    shared = wt.join(lt, ["host", "w"]).select("host", "needle", "label", "trig_seq").distinct()
    by_word = top_n(shared, ["host", "needle"], ["trig_seq"], n, rank="rank").drop("trig_seq")

    rest = want.join(shared.select("host", "needle").distinct(), ["host", "needle"], "left_anti")
    rest = rest.withColumn("low", F.lower("needle"))
    # labels that differ in case only answer as the last of them
    folded = distinct.groupBy("host", F.lower("label").alias("low")).agg(F.max_by("label", "trig_seq").alias("label"))
    rest, folded = (x.alias(a) for x, a in zip(spread(rest, folded, ["low"]), "nl", strict=True))
    # a longer text needs as many edits as it is longer, at least
    la, lb = F.length("n.low"), F.length("l.low")
    bound = F.least(la, lb) >= F.lit(K.SUGGEST_CUTOFF) * F.greatest(la, lb)
    near = (
        rest.join(folded, (F.col("n.host") == F.col("l.host")) & (F.col("n._salt") == F.col("l._salt")) & bound)
        .select("n.host", "n.needle", "l.label", F.col("l.low").alias("low"), closeness(F.col("l.low"), F.col("n.low")).alias("ratio"))
        .where(F.col("ratio") >= K.SUGGEST_CUTOFF)
    )
    by_distance = top_n(near, ["host", "needle"], [F.col("ratio").desc(), F.col("low").desc()], n, rank="rank")
    return by_word.withColumn("found_by", F.lit("word")).unionByName(
        by_distance.drop("ratio", "low").withColumn("found_by", F.lit("closeness"))
    )
