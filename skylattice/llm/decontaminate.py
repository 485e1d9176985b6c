"""Benchmark decontamination: containment search for short items inside long documents.

Texts are lower-cased and cut at everything but letters and digits; a set holds the distinct 5-word
shingles. An item leaks into a document that holds at least 0.8 of its shingles, however long the
document. MinHash signatures of whole documents can't see that (the Jaccard similarity of 20 words and
20,000 is nothing), so the items are sketched, as in containment search over size partitions:

* Items are partitioned by size: class c has 2**c to 2**(c + 1) - 1 shingles. The class sets how many hits a
  candidate needs, h = 2**c / 4 (at least 1), and which documents can hold its items at all: those of 0.8 * 2**c
  shingles or more.
* An item of n shingles keeps its k smallest codes (a bottom-k MinHash), k = n - ceil(0.8 n) + h. A document that holds
  0.8 of the item lacks at most n - ceil(0.8 n) of them, hence holds h of the k: no leak is missed, and one
  common shingle makes no candidate of a longer item.
* Pairs of document and item with h hits are candidates; the exact share of the item's shingles in the document decides.

Everything is DataFrame functions. Sketches and shingles of the items are broadcast while they are few
enough (a checked count) and join by shuffle beyond.

Defined cases: items or documents of fewer than five words (or null, or empty) have no shingles and
never match; repeated rows of a document or item count once; rows with a null identifier can't be named
in the result and are left out; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, let, stage, table

SHINGLE = 5
PERCENT = 80
NOT_WORD = r"[^\p{L}\p{N}]+"


def shingle_codes(text: Column) -> Column:
    """64-bit codes of the 5-word shingles of a text, in order, with repeats."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")

    def of(codes: Column) -> Column:
        n = F.size(codes)
        return F.when(n < SHINGLE, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(codes, i + j) for j in range(SHINGLE))))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, code, n_item, size_class): the shingles of all items."""
    codes = items.filter("item_id IS NOT NULL").select("item_id", F.explode(F.array_distinct(shingle_codes(F.col("text")))).alias("code")).distinct()
    sizes = codes.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return codes.join(sizes, "item_id").withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))


def sketches(shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, code, size_class, hits): the bottom-k codes of each item and how many of them make a candidate."""
    n = F.first("n_item")
    least = shingles.groupBy("size_class", "item_id").agg(F.sort_array(F.collect_list("code")).alias("codes"), n.alias("n"), F.ceil(n * percent / 100).alias("whole"))
    least = least.withColumn("hits", F.least(F.greatest(F.lit(1), F.floor(F.pow(F.lit(2), F.col("size_class")) / 4)), F.col("whole")).cast("long"))
    return least.select("item_id", F.explode(F.slice("codes", F.lit(1), (F.col("n") - F.col("whole") + F.col("hits")).cast("int"))).alias("code"), "size_class", "hits")


def candidates(docs: DataFrame, sketch: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id) with as many hits in the item's sketch as its size class asks for."""
    codes = docs.select("doc_id", F.array_distinct(shingle_codes(F.col("text"))).alias("codes"))
    held = codes.select("doc_id", F.size("codes").alias("n_doc"), F.explode("codes").alias("code"))
    fits = 100 * F.col("n_doc") >= percent * F.pow(F.lit(2), F.col("size_class"))
    found = held.join(few(sketch), "code").filter(fits).groupBy("doc_id", "item_id").agg(F.countDistinct("code").alias("n"), F.first("hits").alias("hits"))
    return found.filter("n >= hits").select("doc_id", "item_id")


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each item that a document contains."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    shingles = stage(item_shingles(items.select("item_id", "text")), "item-shingles")
    found = stage(candidates(docs, stage(sketches(shingles, percent), "sketches"), percent), "candidates")
    wanted = stage(found.join(few(shingles), "item_id").select("doc_id", "item_id", "code", "n_item"), "wanted")
    docs = docs.join(few(found.select("doc_id").distinct()), "doc_id", "left_semi")
    held = docs.select("doc_id", F.explode(F.array_distinct(shingle_codes(F.col("text")))).alias("code"))
    shared = held.join(few(wanted), ["doc_id", "code"]).groupBy("doc_id", "item_id").agg(
        F.countDistinct("code").alias("n_shared"), F.first("n_item").alias("n_item")
    )
    return shared.filter(100 * F.col("n_shared") >= percent * F.col("n_item")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM d WHERE len(ws) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM b WHERE len(ws) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN bs USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
