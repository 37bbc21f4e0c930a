"""License scans by ordered signature rules.

A document's words are matched against the gate words of all rules first; only
rules whose gate word occurs run their pattern. Detections are intervals of
words. A detection that lies inside one of higher priority, or inside a longer
one of the same priority, or on the same words as one of an earlier rule, is
suppressed. Only DataFrame functions are used. Documents without any gate word
meet no rule, and only detections are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import let
from trialweave.llm.license_rules import KINDS, Rule, rules

#: What is no part of a word, once A-Z are lower-cased.
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def normalised(text: Column) -> Column:
    """The words of a text, joined by single spaces and framed by one on each side."""
    folded = F.coalesce(text, F.lit(""))
    for odd in ("\u212a", "\u0130"):  # beyond A-Z, only these have an ASCII letter as lower case
        folded = F.replace(folded, F.lit(odd), F.lit("\u00e9"))
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(folded), _NO_WORD, " ")), F.lit(" "))


def _count(text: Column) -> Column:
    """How many spaces ``text`` has."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _pieces(norm: Column, pattern: Column) -> Column:
    """For every match of one rule, which don't overlap: the words before it since the last one, and its own."""
    found = F.call_function("regexp_extract_all", norm, pattern, F.lit(0))
    both = lambda hits: F.zip_with(hits, F.slice(F.split(norm, pattern), 1, F.size(hits)), lambda h, g: F.struct(_count(g).alias("gap"), _count(h).alias("hit")))
    return let(found, lambda hits: F.when(F.size(hits) > 0, both(hits)))


def detections(docs: DataFrame, signature_rules: list[Rule] | None = None) -> DataFrame:
    """Every match of every rule: doc_id, text_hash, rule, label, kind, priority, weight, first, last."""
    known = [r._replace(gate=g) for r in signature_rules or rules() for g in r.gate.split("|")]
    signatures = docs.sparkSession.createDataFrame(known, "rule int, label string, kind string, gate string, pattern string, priority int, weight double")
    gates = F.array(*(F.lit(g) for g in sorted({r.gate for r in known})))
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normalised(F.col("text")).alias("norm"))
    gated = held.select("doc_id", "text_hash", "norm", F.explode(F.array_intersect(F.split("norm", " "), gates)).alias("gate"))
    matched = gated.join(F.broadcast(signatures), "gate").select("doc_id", "text_hash", *(c for c in signatures.columns if c not in ("gate", "pattern")), F.posexplode(_pieces(F.col("norm"), F.col("pattern"))).alias("k", "piece"))
    # Rows that repeat a text, and rules with two gate words, give the same matches again; they are combined before the shuffle.
    once = matched.dropDuplicates(["doc_id", "text_hash", "rule", "k"]).repartition("doc_id", "text_hash")
    so_far = Window.partitionBy("doc_id", "text_hash", "rule").orderBy("k")
    # The text begins with a space that stands before word 0; a gap and a match end at one each.
    last = F.sum(F.col("piece.gap") + F.col("piece.hit")).over(so_far) - 1
    return once.withColumn("last", last).withColumn("first", F.col("last") - F.col("piece.hit")).drop("k", "piece")


def unsuppressed(found: DataFrame) -> DataFrame:
    """``found`` with ``kept``: not inside a detection that goes before it."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("first", F.desc("last"), F.desc("priority"), "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # In this order whatever holds an interval stands before it, but for an equal interval of higher priority,
    # which also stands before it.
    inside = F.lit(False)
    for level in sorted({priority for priority, _ in KINDS.values()}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("last"))).over(before)
        inside = inside | ((F.col("priority") == level) & (F.coalesce(reach, F.lit(-1)) >= F.col("last")))
    return found.withColumn("kept", ~inside)


def license_scan(docs: DataFrame, signature_rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its detections summed up.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_detections and n_suppressed. Null text counts as empty: no words,
    empty labels, score 0. Rows that repeat doc_id and text get the same result; null
    doc_id is an id like any other; an empty table gives no rows; other columns
    are ignored. ``score`` is the greatest weight among unsuppressed detections.
    """
    found = unsuppressed(detections(docs, signature_rules))
    base = F.col("kind") == "base"
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    summed = found.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | (F.col("kept") & (F.col("kind") != "base"))).alias("labels"),
        F.max(F.when(F.col("kept"), F.col("weight"))).alias("score"),
        F.count(F.lit(1)).alias("n_detections"),
        F.count_if(~F.col("kept")).alias("n_suppressed"),
    )
    words = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    n_words = let(F.btrim(words), lambda w: F.when(w == "", 0).otherwise(_count(w) + 1))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words.cast("long").alias("n_words"))
    zero = {"n_base": 0, "n_detections": 0, "n_suppressed": 0, "score": 0.0, "base_labels": "", "labels": ""}
    out = rows.join(summed, rows["doc_id"].eqNullSafe(summed["_doc"]) & (rows["text_hash"] == summed["_hash"]), "left")
    return out.select("doc_id", "n_words", *((F.coalesce(F.col(c), F.lit(zero[c])) if c in zero else F.col(c)).alias(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections", "n_suppressed")))
