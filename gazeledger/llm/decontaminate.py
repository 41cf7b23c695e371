"""Benchmark decontamination (operator 3): size-partitioned MinHash containment search, in Spark's own expressions only.

Texts are lower-cased and read as runs of letters and digits; shingles are ``WIDTH`` words in a row, hashed. An item with
fewer words is matched as its whole sequence. An item is contained in a document if at least ``percent`` of its distinct
shingles stand in it.

Items are partitioned by size: those with 2**c to 2**(c+1)-1 distinct shingles form class c and are sketched by their k
least hashes (bottom-k MinHash), where k is one more than the shingles an item of the class may miss. So every document
that contains an item holds at least one hash of its sketch, however long it is, and no containing pair is lost. Documents
with too few shingles for an item are no candidates. Candidates are verified by exact containment of the full sets.

Sketches and item sets are broadcast only while their counted rows are few, else joined with a shuffle. NULL and empty
texts contain nothing and are contained in nothing. Rows that repeat an item id count as items of their own, of which the
best containment is reported; rows that repeat a document id count as one document. Documents with a NULL id are not
searched (and ``clean`` keeps them). Empty tables give empty results. Only the named columns are read; ``clean`` keeps
all columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.functions.regex import let
from gazeledger.llm.common import BROADCAST_ROWS, keep_ids, materialise

WIDTH = 5
CLASSES = 31


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(text: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; none if the text is shorter."""

    def runs(own: Column) -> Column:
        n = F.size(own) - width
        at = F.sequence(F.lit(0), F.greatest(n, F.lit(0)))
        hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(width)]))
        return F.when(n >= 0, hashed).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), runs)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def item_sets(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``item_key, item_id, width, hashes`` of items that have words."""
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    own = own.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text", F.size(words(F.col("text"))).alias("w")).where("w > 0")
    own = own.withColumn("width", F.least(F.lit(width), F.col("w")))
    hashes = F.array().cast("array<bigint>")
    for w in range(1, width + 1):
        hashes = F.when(F.col("width") == w, shingles(F.col("text"), w)).otherwise(hashes)
    return own.select("item_key", "item_id", "width", F.array_sort(F.array_distinct(hashes)).alias("hashes"))


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """One row per hash of a sketch: ``h, item_key, needed``; ``needed`` is the least number of shared shingles."""
    n = F.size("hashes")
    k = F.lit(0)
    for c in range(CLASSES):
        most = 2 ** (c + 1) - 1
        k = F.when(n.between(2**c, most), F.lit(most * (100 - percent) // 100 + 1)).otherwise(k)
    needed = F.ceil(n * percent / 100)
    return sets.select(F.explode(F.slice("hashes", 1, k)).alias("h"), "item_key", needed.alias("needed"))


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = 80,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` for every document and item it contains."""
    sets = materialise(item_sets(items, width, item_id_col, item_text_col), "items")
    widths = [r["width"] for r in sets.select("width").distinct().collect()]  # at most ``width`` numbers
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    found = None
    for w in widths or [width]:
        of_width = sets.where(F.col("width") == w)
        sketch = _small(materialise(sketches(of_width, percent), "sketches"))
        hashed = own.select("doc_id", shingles(F.col("text"), w).alias("hashes"))
        candidates = (
            hashed.select("doc_id", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
            .join(sketch, "h").where(F.col("n") >= F.col("needed")).select("doc_id", "item_key").distinct()
        )
        candidates = materialise(candidates, "candidates")
        ids = materialise(candidates.select("doc_id").distinct(), "candidate-ids")
        whole = keep_ids(own, ids, "doc_id").select("doc_id", shingles(F.col("text"), w).alias("hashes"))
        checked = whole.join(candidates, "doc_id").join(_small(of_width.select("item_key", "item_id", F.col("hashes").alias("wanted"))), "item_key")
        pairs = checked.select(
            "doc_id", "item_id", F.size("wanted").cast("bigint").alias("n_item"),
            F.size(F.array_intersect("wanted", "hashes")).cast("bigint").alias("n_shared"))
        found = pairs if found is None else found.union(pairs)
    best = found.where(100 * F.col("n_shared") >= percent * F.col("n_item")).groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that contain no item."""
    bad = materialise(found.select(F.col("doc_id").alias(id_col)).distinct(), "leaks")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, id_col, "left_anti").select(*docs.columns)


def oracle(width: int = WIDTH, percent: int = 80) -> str:
    """The same result in DuckDB for items of at least ``width`` words."""
    words_of = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '')"
    grams = f"unnest(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')))"
    return f"""
with d as (select distinct doc_id, {grams} as g from (select doc_id, {words_of} as w from documents where doc_id is not null)),
i as (select distinct item_id, {grams} as g from (select item_id, {words_of} as w from benchmark)),
n as (select item_id, count(*) as n_item from i group by item_id),
s as (select doc_id, item_id, count(*) as n_shared from d join i using (g) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment
from s join n using (item_id) where 100 * n_shared >= {percent} * n_item"""
