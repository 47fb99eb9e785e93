"""Interaction of filters: what each of five removes in each order, by part.

Every text gets a mask with a bit for each filter that it fails, from native expressions. The texts themselves never leave
their task: copies meet by the SHA-256 of a text, whose group supplies the smallest doc_id. Repeated rows are counted
together before they are shuffled, and so are the copies of a text, so that a text of which there are millions of copies is
a few rows wherever it is met. Of a part only the counts of its 32 masks are left, and the 120 orders are read off these.

The filters, in letters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] > 3 * code points; D holds one
of #$%&*|; E the text of a smaller doc_id. Words are maximal runs of other characters than blank and \\x09-\\x0D.

A null text is empty, and equal to other empty ones. A null lang is the part of the empty string. A row without an id is
never a copy (it does not fail E), makes no copies and has no labels; a repeated row is no copy of its equal, as its id is
not smaller. A document is good or toxic if any row of labels for its id says so. A table without rows has no parts; other
columns are never read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
_BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}


def with_mask(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and mask: the bits of the filters that look at one text alone, A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    cut = named.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}
    mask = sum((F.when(fail, _BIT[letter]).otherwise(0) for letter, fail in fails.items()), F.lit(0))
    return cut.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: a row for each id that is either."""
    is_one = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (0 to 31, with the bit of E), n, good, toxic: the histogram of failure masks."""
    # rows without an id meet no label, and are dealt by the task that read them
    deal = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(-1).alias("deal")
    once = with_mask(docs).groupBy("doc_id", deal, "digest", "part", "mask").agg(F.count("*").alias("times"))
    met = once.join(labels_of(labels).withColumn("deal", F.lit(-1)), ["doc_id", "deal"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times")))
    nameless = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("times"))), F.lit(0))
    alike = met.groupBy("digest", "mask", "part", *flags).agg(first.alias("first"), F.sum("times").alias("n"), nameless.alias("nameless"))
    # a text has a row for each part and pair of flags here
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    counted = alike.withColumn("originals", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.times")).otherwise(0))
    kinds = F.explode(F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + _BIT["E"]).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    each = counted.select("part", "good", "toxic", kinds.alias("x")).select("part", "good", "toxic", "x.*")
    having = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), having("good"), having("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step in it, whose filter is the order's letter there.

    kept: documents of the part after the step; removed: by it; redundant: that fail its filter but went before;
    unique_fails: that fail no other filter; good_lost, toxic_lost: removed ones that are labelled so; shapley: removed by its
    filter, at any step, summed over all orders.
    """
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    ordered = parts.select("part", "cells", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order"))
    steps = ordered.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {letter: F.instr("filter_order", letter) for letter in FILTERS}
    bits = lambda at: sum((F.when(at(place[x]), _BIT[x]).otherwise(0) for x in FILTERS), F.lit(0))
    steps = steps.withColumns({"own": bits(lambda p: p == F.col("step")), "before": bits(lambda p: p < F.col("step"))})

    def total(name: str, where, of: str = "n") -> Column:
        has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
        here = lambda c: where(has(c, F.col("own")), has(c, F.col("before")), c["mask"])
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(here(c), c[of]).otherwise(0)).alias(name)

    removed = lambda own, before, _: own & ~before
    # of all orders, those in which a filter comes first of the failing ones of a mask are one in as many as these are
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(F.col("own")) != 0, c["n"] * F.get(F.array(*(F.lit(len(ORDERS) // max(i, 1)) for i in range(len(FILTERS) + 1))), F.bit_count(c["mask"]))).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", total("kept", lambda own, before, _: ~own & ~before), total("removed", removed), total("redundant", lambda own, before, _: own & before),
        total("unique_fails", lambda own, before, mask: mask == F.col("own")), total("good_lost", removed, "good"), total("toxic_lost", removed, "toxic"), shapley.alias("shapley"),
    )


#: The same for DuckDB, by masks of whole rows and a walk through each order.
AUDIT_SQL = r"""WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
fails AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM words),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
same AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, instr('ABCDE', substr(filter_order, s, 1)) AS i FROM orders, range(1, 6) r(s)),
walked AS (SELECT part, filter_order, step, i, f, n, good, toxic, f[i] AS own,
    list_bool_or(list_concat([false], list_transform(range(1, step), lambda p: f[instr('ABCDE', substr(filter_order, p, 1))]))) AS before FROM steps, same),
counted AS (SELECT part, filter_order, step, i, CAST(coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT before), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (own AND before), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (own AND len(list_filter(f, lambda y: y)) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (own AND NOT before), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS BIGINT) AS toxic_lost FROM walked GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM counted"""
