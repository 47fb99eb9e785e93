"""Benchmark decontamination: short test items inside long documents, in DataFrame functions only.

Texts are lower-cased and cut at white space; their shingles are runs of five words. Items are partitioned by their
number of shingles, doubling from class to class. For a class whose items have fewer than 2^(c+1) shingles, documents are
cut into blocks of twice that many shingles; an item inside a document then shares a fair part of at most two
neighbouring blocks, whatever the document's length. Item and blocks get one-permutation MinHash signatures: the least
hash in each of a number of hash ranges, more of them for larger classes. One equal entry makes a candidate, and the
ranges are so many that an item contained by at least CONTAINMENT is missed with a chance below 1e-3. Candidates are
verified on shingles, word for word: the share of the item's distinct shingles that the whole document has.

The items' signatures are broadcast only where they are few (BROADCAST_ROWS); beyond that the join is a shuffle.

Null texts are empty. A text of fewer than five words has one shingle of all its words; without words it has none, and
matches nothing. Null ids are values like others. Rows with the same ids give one row, with the highest containment; rows
are told apart by id and text, so that decontaminate() takes out none but the rows that have an item. Other columns don't
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ROW, free_name, row_identity, with_rows, without_rows
from loomgraph.plans.session import stored

WIDTH = 5
CONTAINMENT = 0.8
RANGES_LOG2 = 6
#: Ranges for items of fewer than 8 shingles, where one of few shingles must not be lost.
SMALL_RANGES_LOG2 = 16
BROADCAST_ROWS = 100_000
#: Candidate items that one copy of a document's shingles is held against.
ITEMS_EACH = 64
#: The last class takes all larger items; they only meet smaller blocks than they could.
LARGEST = 12


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it; an expression in a lambda is else run each time."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of WIDTH words of a text."""
    return let(words(text), lambda w: F.transform(_starts(w), lambda at: F.xxhash64(*(F.get(w, at + k) for k in range(WIDTH)))))


def shingle_texts(text: Column) -> Column:
    """The distinct runs of WIDTH words of a text."""
    return F.array_distinct(let(words(text), lambda w: F.transform(_starts(w), lambda at: F.array_join(F.slice(w, at + 1, WIDTH), " "))))


def _starts(w: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0)))
    return F.slice(starts, 1, F.when(F.size(w) > 0, F.size(starts)).otherwise(0))


def size_class(n: Column) -> Column:
    """0 for up to 7 shingles, then the doublings: 1 for 8 to 15, 2 for 16 to 31, ..."""
    return F.least(F.greatest(F.floor(F.log2(n)).cast("int") - 2, F.lit(0)), F.lit(LARGEST))


def block_size(c: int) -> int:
    return 16 << c


def ranges_log2(c: int) -> int:
    return SMALL_RANGES_LOG2 if c == 0 else max(RANGES_LOG2, c + 3)


def minima(hashes: Column, bits: int) -> Column:
    """One-permutation MinHash: the least hash in each of 2^bits ranges that has any."""
    rank = lambda h: F.shiftrightunsigned(h, 64 - bits)
    return let(F.sort_array(hashes), lambda o: F.filter(o, lambda h, i: (i == 0) | (rank(h) != rank(F.get(o, i - 1)))))


def document_signatures(hashes: Column, c: int) -> Column:
    """The signature entries of all blocks of a document, for a class."""
    size, bits = block_size(c), ranges_log2(c)
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(hashes) - 1) / size).cast("int"), F.lit(0)))
    return F.flatten(F.transform(starts, lambda b: minima(F.slice(hashes, b * size + 1, size), bits)))


def item_signatures(items: DataFrame) -> DataFrame:
    """item_id, class, h: the signature entries of each item."""
    hashed = items.select("item_id", F.array_distinct(shingle_hashes(F.col("text"))).alias("hs")).where(F.size("hs") > 0)
    classed = hashed.withColumn("class", size_class(F.size("hs")))
    entries = F.coalesce(*(F.when(F.col("class") == c, minima(F.col("hs"), ranges_log2(c))) for c in range(LARGEST + 1)))
    return classed.select("item_id", "class", F.explode(entries).alias("h"))


def candidates(docs: DataFrame, signatures: DataFrame) -> DataFrame:
    """doc_id, row, item_id of documents (doc_id, row, text) with a block that shares a signature entry with the item."""
    classes = sorted(r["class"] for r in signatures.select("class").distinct().collect())
    if signatures.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        signatures = F.broadcast(signatures)
    if not classes:
        return docs.select("doc_id", ROW).limit(0).crossJoin(signatures.select("item_id").limit(0))
    every = let(shingle_hashes(F.col("text")), lambda hs: F.array(*(F.struct(F.lit(c).alias("class"), document_signatures(hs, c).alias("entries")) for c in classes)))
    sketched = docs.select("doc_id", ROW, F.explode(every).alias("x")).select("doc_id", ROW, "x.class", F.explode("x.entries").alias("h"))
    return sketched.join(signatures, ["class", "h"]).select("doc_id", ROW, "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, row, item_id, n_shared, n_shingles, containment of every row of docs that contains an item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_identity().alias(ROW), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = stored(candidates(docs, stored(item_signatures(items), "signatures")), "candidates")
    asked = items.select(F.col("item_id").alias("_item"), shingle_texts(F.col("text")).alias("asks")).distinct()
    pairs = found.join(asked, F.col("item_id").eqNullSafe(F.col("_item"))).select("doc_id", ROW, "item_id", "asks")
    # a document's shingles are made once for each ITEMS_EACH of its candidates
    sized = stored(found.groupBy("doc_id", ROW).agg(F.count("*").alias("n")), "suspects")
    pairs = pairs.join(sized.select(F.col("doc_id").alias("_id"), F.col(ROW).alias("_row"), "n"), (F.col(ROW) == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    part = F.pmod(F.xxhash64("item_id", "asks"), F.ceil(F.col("n") / ITEMS_EACH)).alias("part")
    asking = pairs.groupBy("_id", "_row", part).agg(F.collect_list(F.struct("item_id", "asks")).alias("items"))
    suspects = with_rows(docs, ROW, sized).join(stored(asking, "asking"), (F.col(ROW) == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    each = let(shingle_texts(F.col("text")), lambda has: F.transform("items", lambda x: F.struct(
        x["item_id"].alias("item_id"), F.size(F.array_intersect(x["asks"], has)).cast("long").alias("n_shared"), F.size(x["asks"]).cast("long").alias("n_shingles"))))
    scored = suspects.select("doc_id", ROW, F.explode(each).alias("x")).select("doc_id", ROW, "x.*")
    scored = scored.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= containment)
    best = F.max(F.struct("containment", "n_shared", "n_shingles")).alias("x")
    return scored.groupBy("doc_id", ROW, "item_id").agg(best).select("doc_id", ROW, "item_id", "x.n_shared", "x.n_shingles", "x.containment")


def leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every document that contains an item."""
    best = F.max(F.struct("containment", "n_shared", "n_shingles")).alias("x")
    return contained(docs, items, containment).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_shared", "x.n_shingles", "x.containment")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that contain no item, with all their columns."""
    bad = stored(contained(docs, items).select("doc_id", ROW).distinct(), "contaminated")
    name = free_name(docs, "row")
    return without_rows(docs.withColumn(name, row_identity()), name, bad).drop(name)


LEAKS_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
s AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN s USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared / n_shingles >= 0.8
"""
