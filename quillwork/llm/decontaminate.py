"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed hashes the tokens that a mask selects and ignores the others, so it
survives a substitution at an ignored position. Seeds of the benchmark are
joined with the seeds of every position of every document; around each hit the
document's tokens are laid over the item's and compared one by one. An overlap
counts if, within WINDOW consecutive tokens of the item (all of a shorter
item), at least NEED of them are equal.

The first mask alone hits every such overlap of WINDOW tokens; the three
together also hit those of items of 8 to 12 tokens (both checked by
enumeration in the tests), so hashing loses nothing against the definition.

Edge cases: tokens are runs of letters and digits in lower case; null, empty
and token-less texts have no overlap; items of fewer than 8 tokens are no
evidence and match nothing; repeated rows of a document count once; rows with
the same doc_id are one document in the result; a null doc_id is a document of
its own; an empty benchmark or table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.shared import table, unused

TOKEN = r"[\p{L}\p{N}]+"
GAP = r"[^\p{L}\p{N}]+"
WINDOW, SHARE, SHORTEST = 13, 0.8, 8
#: Selected positions; fixed. The others serve items shorter than WINDOW.
MASKS = ((0, 1, 3, 6, 7), (0, 3, 4, 5, 6), (0, 1, 3, 5, 7))
#: Seeds broadcast at once (40 bytes each); a larger benchmark takes several passes.
SEEDS = 500_000


def _seed(tokens: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(tokens, at + F.lit(o)) for o in mask])


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_tokens(benchmark: DataFrame) -> DataFrame:
    """item_id, item (its token hashes), n of the items that can match."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    items = benchmark.where("text IS NOT NULL").select("item_id", _hashed(words).alias("item"))
    return items.withColumn("n", F.size("item")).where(F.col("n") >= SHORTEST)


def benchmark_seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """key, item_id, ipos, n: every seed of every item."""
    tables = []
    for number, mask in enumerate(masks):
        places = F.sequence(F.lit(0), F.col("n") - F.lit(mask[-1] + 1))
        tables.append(items.select("item_id", "n", F.posexplode(_seeds_at(places, mask, number, "item")).alias("ipos", "key")))
    return reduce(DataFrame.unionAll, tables).select("key", "item_id", "ipos", "n").distinct()


def _seeds_at(places: Column, mask: tuple[int, ...], number: int, tokens: str) -> Column:
    return F.transform(places, lambda i: _seed(F.col(tokens), i, mask, number))


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row, item_id, offset, matched: each alignment that counts, with its best window's equal tokens.

    row is the hash of the document's text; offset is the token of the document that the item's first token lies on.
    Documents are read once for every SEEDS seeds of the benchmark (in most
    uses once); exploded seeds meet the broadcast table before any shuffle, and
    only the tokens under an item are shuffled, a row an alignment.
    """
    items = benchmark_tokens(benchmark)
    shortest, n_items = items.agg(F.min("n"), F.count("*")).first()
    masks = MASKS if n_items and shortest < WINDOW else MASKS[:1]
    seeds = benchmark_seeds(items, masks)
    passes = max(1, -(-seeds.count() // SEEDS))

    words = F.split(F.lower(F.coalesce("text", F.lit(""))), GAP)
    tokens = documents.select("doc_id", F.xxhash64("text").alias("row"), _hashed(words).alias("tokens"))
    tokens = tokens.withColumn("size", F.size("tokens"))
    places = F.sequence(F.lit(0), F.col("size") - 1)
    keys = F.concat(*[_seeds_at(places, mask, number, "tokens") for number, mask in enumerate(masks)])
    placed = tokens.select("doc_id", "row", "tokens", "size", F.posexplode(keys).alias("place", "key"))

    found = []
    for k in range(passes):
        some = seeds.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k) if passes > 1 else seeds
        hits = placed.join(F.broadcast(some), "key")  # at most about SEEDS rows
        start = F.col("place") % F.col("size") - F.col("ipos")
        first, last = F.greatest(start, F.lit(0)), F.least(start + F.col("n"), F.col("size"))
        under = F.slice("tokens", first + 1, last - first)
        found.append(hits.select("doc_id", "row", "item_id", start.alias("offset"), under.alias("under")))
    aligned = reduce(DataFrame.unionAll, found).groupBy("doc_id", "row", "item_id", "offset").agg(F.first("under").alias("under"))

    compared = aligned.join(items, "item_id")
    own = F.slice("item", F.greatest(-F.col("offset"), F.lit(0)) + 1, F.size("under"))
    equal = compared.withColumn("equal", F.zip_with("under", own, lambda a, b: (a == b).cast("int")))
    width = F.least(F.lit(WINDOW), F.col("n"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("equal") - width + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.aggregate(F.slice("equal", i, F.least(F.lit(WINDOW), F.col("n"))), F.lit(0), lambda s, x: s + x))
    best = equal.select("doc_id", "row", "item_id", "offset", "n", F.array_max(windows).alias("matched"))
    return best.where(F.col("matched") >= F.ceil(F.least(F.lit(WINDOW), F.col("n")) * SHARE)).groupBy("doc_id", "row", "item_id", "offset").agg(F.max("matched").alias("matched"))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids, matched of every document that overlaps an item."""
    return overlaps(documents, benchmark).groupBy("doc_id").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"),
        F.max("matched").cast("long").alias("matched"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item; rows are told apart by doc_id and text, so a clean row stays beside a leaking one of its id."""
    doc, text = (unused(documents, name) for name in ("leak_id", "leak_text"))
    leaks = overlaps(documents, benchmark).select(F.col("doc_id").alias(doc), F.col("row").alias(text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(text))
    return documents.join(leaks, same, "left_anti")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS dpos
  FROM (SELECT doc_id, hash(text) AS row, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents)
), i AS (
  SELECT item_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS ipos
  FROM (SELECT item_id, words, len(words) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM benchmark))
  WHERE n >= 8
), m AS (
  SELECT DISTINCT doc_id, row, item_id, n, dpos - ipos AS diagonal, ipos FROM d JOIN i USING (word)
), w AS (
  SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, row, item_id, diagonal ORDER BY ipos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS matched FROM m
)
SELECT doc_id, count(DISTINCT item_id) AS n_items,
       array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids, max(matched) AS matched
FROM (SELECT * FROM w WHERE matched >= ceil(least(13, n) * CAST(0.8 AS DOUBLE)))
GROUP BY doc_id
"""
