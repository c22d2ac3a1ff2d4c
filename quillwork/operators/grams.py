"""A posting table of three-letter grams that spares a substring search most of its scan.

Articles are kept in blocks by document, a block's documents in slices of about
SLICE articles. For every gram, block and 64 slices one row has a mask of the
slices whose text, number or chapter hold the gram (in lower case, as the search
compares). A search reads the rows of its term's grams, takes the slices that
hold all of them and those of documents whose title matches, reads their blocks,
and applies the search's own predicate: it gives the rows that the scan gives,
as the grams of a term are in whatever holds it. Wildcards cut a term into parts;
a term without a part of three letters scans.

A mask is a number, so it is put together where a block is read, and what is
shuffled and kept are the different grams of some hundred articles, not a row a
gram and article.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.text import like_any
from quillwork.operators import corpus

SIZE = 3
BLOCK_ROWS, BUCKETS = 50_000, 16
#: Articles a slice, on average, and slices a mask.
SLICE, MASK = 16, 64
#: What a search gives of an article; other columns are not kept.
KEPT = ("id", "document_id", "article_number", "text", "sort_key", "chapter", "path")
#: The fields of an article that a search compares; titles are searched where they are, in documents.
FIELDS = ("text", "article_number", "chapter")


def grams_of(text: Column) -> Column:
    """All grams of a text in lower case, in one pass; none of null. None begins within a surrogate pair."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?![\uDC00-\uDFFF])(?=(.{%d}))" % SIZE), F.lit(1)), F.array().cast("array<string>"))


def needed_grams(spark: SparkSession, term: str) -> list[str]:
    """The grams that whatever contains the term holds; none if its parts are too short."""
    low = spark.range(1).select(F.lower(F.lit(term))).first()[0]  # as the search lowers it
    parts = re.split("[%_]", low)
    return sorted({part[k : k + SIZE] for part in parts for k in range(len(part) - SIZE + 1)})


SHAPE = "blocks long, buckets long, slices long"


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(blocks)).alias("block")


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64("document_id", F.lit(SIZE)), F.lit(slices)).cast("int")


def _word(slices: int) -> Column:
    """Which mask of its block has the slice of a document."""
    return F.floor(_slice(slices) / MASK).cast("int").alias("word")


def _mask(slices: int) -> Column:
    """The bit of a document's slice."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _slice(slices) % MASK).alias("mask")


class GramIndex:
    """Articles in blocks and their postings under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, articles: DataFrame, block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS) -> GramIndex:
        """Writes the index of the articles; their ids are unique."""
        blocks, slices = max(1, -(-articles.count() // block_rows)), MASK * max(1, block_rows // (MASK * SLICE))
        self.spark.createDataFrame([(blocks, buckets, slices)], SHAPE).coalesce(1).write.mode("overwrite").json(f"{self.root}/shape")
        placed = articles.select(*KEPT).withColumn("block", _block(blocks))
        placed.repartition("block").write.mode("overwrite").option("compression", "zstd").partitionBy("block").parquet(f"{self.root}/articles")
        rows = self.spark.read.parquet(f"{self.root}/articles")
        all_grams = F.array_distinct(F.concat(*[grams_of(F.col(c)) for c in FIELDS]))
        held = rows.select("block", _word(slices), _mask(slices), F.explode(all_grams).alias("gram"))
        lists = held.groupBy("gram", "block", "word").agg(F.bit_or("mask").alias("mask"))
        dealt = lists.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
        dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/postings")
        return self

    def articles(self, blocks: list[int] | None = None) -> DataFrame:
        """The articles, or those of some blocks: only their files are read."""
        whole = self.spark.read.parquet(f"{self.root}/articles")
        if blocks is None:
            return whole.drop("block")
        if not blocks:
            return whole.limit(0)
        folders = [f"{self.root}/articles/block={b}" for b in blocks]
        return self.spark.read.schema(whole.schema).option("basePath", f"{self.root}/articles").parquet(*folders)

    def holding(self, grams: list[str]) -> DataFrame:
        """block, word, mask of the slices that hold every gram."""
        buckets = self._shape()[1]
        number = F.transform(F.array(*[F.lit(g) for g in grams]), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)))
        asked = self.spark.range(1).select(F.array_distinct(number)).first()[0]
        own = self.spark.read.parquet(f"{self.root}/postings").where(F.col("bucket").isin(*asked) & F.col("gram").isin(*grams))
        return own.groupBy("block", "word").agg(F.count("*").alias("n"), F.bit_and("mask").alias("mask")).where((F.col("n") == len(grams)) & (F.col("mask") != 0)).drop("n")

    def _shape(self) -> tuple[int, int, int]:
        row = self.spark.read.schema(SHAPE).json(f"{self.root}/shape").first()
        return row.blocks, row.buckets, row.slices

    def _candidates(self, documents: DataFrame, titles: list[str], grams: list[str]) -> DataFrame:
        """The articles that the search's predicate has to be applied to, read from their blocks alone."""
        count, _, slices = self._shape()
        titled = F.lit(False)
        for t in titles:
            titled = titled | like_any(["title"], t)
        named = documents.where(titled).select(F.col("id").alias("document_id")).select(_block(count), _word(slices), _mask(slices))
        asked = self.holding(grams).unionByName(named).groupBy("block", "word").agg(F.bit_or("mask").alias("asked"))
        blocks = [r.block for r in asked.select("block").distinct().collect()]  # numbers of blocks
        rows = self.articles(sorted(blocks)).withColumns({"word": _word(slices), "mask": _mask(slices)})
        wanted = F.col("mask").bitwiseAND(F.col("asked")) != 0
        a, w = rows.alias("a"), F.broadcast(asked).alias("w")  # a number a thousand articles
        return a.join(w, (F.col("a.block") == F.col("w.block")) & (F.col("a.word") == F.col("w.word")) & wanted, "left_semi").drop("block", "word", "mask")

    def search(self, documents: DataFrame, term: str, language: str | None = None, type: str | None = None) -> DataFrame:
        """The rows of `corpus.search_articles` over the indexed articles."""
        grams = needed_grams(self.spark, term) if term not in ("", "0", None) else []
        if not grams:
            return corpus.search_articles(documents, self.articles(), term, language, type)
        titles = [term, *([term.split(corpus.SEPARATOR, 1)[0]] if corpus.SEPARATOR in term else [])]
        return corpus.search_articles(documents, self._candidates(documents, titles, grams), term, language, type)

    def suggestions(self, documents: DataFrame, term: str, most: int = corpus.SUGGESTIONS) -> DataFrame:
        """The rows of `corpus.suggestions` over the indexed articles."""
        grams = needed_grams(self.spark, term)
        rows = self._candidates(documents, [term], grams) if grams else self.articles()
        return corpus.suggestions(documents, rows, term, most)

    def bytes_read(self, rows: DataFrame) -> tuple[int, int]:
        """Bytes of the articles' files that a result's plan reads, and of all of them."""

        def size(files: list[str]) -> int:
            path, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
            return sum((p := path(f)).getFileSystem(conf).getFileStatus(p).getLen() for f in set(files))

        own = [f for f in rows.inputFiles() if "/articles/block=" in f]
        return size(own), size(self.spark.read.parquet(f"{self.root}/articles").inputFiles())
