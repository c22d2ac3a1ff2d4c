"""Phrase collocations, counted in counting quotient filters.

A word's id is the 64-bit hash of its language and itself; that no two words
of the corpus share an id (else another seed is taken) makes ids lossless, and
nothing has to carry a dictionary to the texts. A phrase that occurs `least`
times has only words that do, so other words break phrases. Which ids are
frequent enough is a bitmap of bounded size (BITMAP), built by aggregation and
broadcast; ids that hit it by chance cost counters, not correctness.

Each task gives its chunk's words local numbers, packs those of two to four
words into one integer, counts them by sorting, and puts the counts under the
words' ids into a filter. Pairs are counted first: a longer phrase that occurs
`least` times holds only pairs that do, and a second bitmap tells them. Filters are cut into shards by ranges of the permuted
keys, packed, shuffled by shard and merged there as sorted runs. Phrases are
spread by their permuted keys and counted before the shuffle, so a common word,
phrase or language loads no task. What is left is small and joined by Spark.

Edge cases: null, empty and blank texts have no words; a null language is
'und'; repeated rows count as often; ids play no part; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.quotient import Filter, permuted
from quillwork.llm.shared import batch, slices, table, written

LONGEST = 4
WORDS = [f"w{k + 1}" for k in range(LONGEST)]
#: Bits of the bitmap of frequent ids: 32 an id, at least 2**20 and at most 2**30 (128 MB).
BITMAP = (20, 30)
#: Words a chunk, different words a chunk and words of a text put in at once (four numbers below their sum fit 64 bits).
CHUNK, NUMBERED, PART = 1 << 20, 60_000, 4096
#: Entries of a filter and different words counted before they are passed on.
ENTRIES, COUNTED = 1 << 20, 300_000
#: Words of the corpus a shard of filters.
SHARD_WORDS = 4_000_000
BREAK = b"\xff"  # no UTF-8 text has this byte
#: Bits, and how many leading bits of an id choose one.
Bitmap = tuple[np.ndarray, int]
TO_BREAKS = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z), with BREAK between pieces."""
    return text.encode("utf-8", "replace").lower().translate(TO_BREAKS).replace(BREAK, b" \xff ").split()


def word_id(language: str, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"%d:%b:%b" % (len(language), language.encode(), word), seed)


def signed(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64).view(np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for rows in slices(batches, "text"):
        yield from zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def word_counts(documents: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, f of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(BREAK, None)
                words = list(found)
                for a in range(0, len(words), 20_000):
                    some = words[a : a + 20_000]
                    ids = signed(np.array([word_id(lang, w, seed) for w in some], np.uint64))
                    yield batch({"lang": ([lang] * len(some), pa.string()), "word": ([w.decode() for w in some], pa.string()), "id": (ids, pa.int64()), "f": ([found[w] for w in some], pa.int64())})
            counts.clear()

        for lang, text in _pairs(batches):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield from passed_on()
        yield from passed_on()

    rows = _texts(documents).mapInArrow(run, "lang string, word string, id long, f long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def lossless_words(documents: DataFrame, seeds: int = 16) -> tuple[DataFrame, int]:
    """The words, written once, and a seed under which no two of them share an id."""
    for seed in range(seeds):
        words = written(word_counts(documents, seed), "words")
        if words.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id = 0").isEmpty():
            return words, seed
    raise ValueError(f"words share ids under each of {seeds} seeds")


def frequent_bitmap(frequent: DataFrame) -> Bitmap:
    """A bitmap of the leading bits of the frequent ids, and how many bits they are."""
    bits = min(BITMAP[1], max(BITMAP[0], (32 * frequent.count()).bit_length()))
    slot = F.shiftrightunsigned("id", 64 - bits) + 1
    parts = frequent.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("part"))
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for r in parts.toLocalIterator():  # at most 2**15 parts of 4 KB
        at = (r.bucket - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(bytes(r.part), np.uint8)
    return bitmap, bits


def _in(bitmap: Bitmap, ids: np.ndarray) -> np.ndarray:
    slot = (ids >> np.uint64(64 - bitmap[1])).astype(np.int64)
    return (bitmap[0][slot >> 3] >> (slot & 7) & 1).astype(bool)


def chunk_filters(lang: str, numbers: list[int], words: list[bytes], seed: int, sizes: range, frequent: Bitmap, pairs: Bitmap | None) -> list[Filter]:
    """A filter for each of `sizes`, of the phrases of so many words in a chunk; of frequent words and, if given, pairs.

    numbers: the words' places in `words`, whose first is BREAK; negative where
    a phrase may go on but not begin.
    """
    ids = np.array([0, *(word_id(lang, w, seed) for w in words[1:])], np.uint64)
    kept = _in(frequent, ids)
    kept[0] = False
    ids = np.concatenate([[np.uint64(0)], ids[kept]])
    renumbered = np.where(kept, np.cumsum(kept), 0).astype(np.uint64)
    places = np.array(numbers, np.int64)
    one = renumbered[np.abs(places)]
    width = np.uint64(max(1, (len(ids) - 1).bit_length()))
    mask = np.uint64((1 << int(width)) - 1)
    goes_on = (one[:-1] > 0) & (one[1:] > 0)
    if pairs is not None:
        at = np.flatnonzero(goes_on)
        goes_on[at] = _in(pairs, permuted(np.column_stack([ids[one[at].astype(np.int64)], ids[one[at + 1].astype(np.int64)]]))[:, 0])
    filters, key, whole = [], one, (one > 0) & (places > 0)
    for n in range(2, sizes[-1] + 1):
        key = (key[:-1] << width) | one[n - 1 :]
        whole = whole[:-1] & goes_on[n - 2 :]
        if n in sizes:
            packed, counts = np.unique(key[whole], return_counts=True)
            columns = [ids[(packed >> width * np.uint64(n - 1 - k) & mask).astype(np.int64)] for k in range(n)]
            filters.append(Filter.of(np.column_stack(columns), counts))
    return filters


def filter_shards(documents: DataFrame, seed: int, shards: int, sizes: range, frequent: Bitmap, pairs: Bitmap | None = None) -> DataFrame:
    """shard, n, filter: packed filters of each task's phrases of n words."""
    sent = documents.sparkSession.sparkContext.broadcast((frequent, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, tuple[list[int], dict[bytes, int]]] = {}
        held: dict[int, list[Filter]] = {n: [] for n in sizes}

        def hold(lang: str) -> Iterator[pa.RecordBatch]:
            numbers, words = chunks.pop(lang)
            for n, found in zip(sizes, chunk_filters(lang, numbers, list(words), seed, sizes, *sent.value)):
                held[n].append(found)
                if sum(map(len, held[n])) > ENTRIES:
                    held[n] = [Filter.merged(held[n])]
                    if len(held[n][0]) > ENTRIES // 2:
                        yield from passed_on(n)

        def passed_on(n: int) -> Iterator[pa.RecordBatch]:
            if held[n]:
                parts = Filter.merged(held[n]).shards(shards)
                held[n] = []
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    yield batch({"shard": ([s for s, _ in some], pa.int32()), "n": ([n] * len(some), pa.int32()), "filter": ([f.packed() for _, f in some], pa.binary())})

        for lang, text in _pairs(batches):
            found = words_of(text)
            for a in range(0, len(found), PART):
                numbers, words = chunks.setdefault(lang, ([], {BREAK: 0}))
                number = lambda w: words.setdefault(w, len(words))  # noqa: B023, E731
                numbers.extend(map(number, found[a : a + PART]))
                numbers.extend([-number(w) for w in found[a + PART : a + PART + LONGEST - 1]])
                numbers.append(0)
                if len(numbers) > CHUNK or len(words) > NUMBERED:
                    yield from hold(lang)
        for lang in list(chunks):
            yield from hold(lang)
        for n in sizes:
            yield from passed_on(n)

    return _texts(documents).mapInArrow(run, "shard int, n int, filter binary")


def merged_shards(filters: DataFrame, least: int) -> DataFrame:
    """n, w1 to w4 (0 beyond n), f, hash (the permuted first id) of the phrases that all filters together count `least` times: sorted filters merge shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def counted() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            kept = Filter.merged(held).at_least(least)
            keys = np.zeros((len(kept), LONGEST), np.uint64)
            keys[:, : now[1]] = kept.plain()
            if len(kept):
                yield batch({"n": (np.full(len(kept), now[1], np.int32), pa.int32()), **{f"w{k + 1}": (signed(keys[:, k].copy()), pa.int64()) for k in range(LONGEST)}, "f": (kept.counts, pa.int64()), "hash": (signed(kept.keys[:, 0].copy()), pa.int64())})

        for rows in batches:
            for shard, n, blob in zip(*(c.to_pylist() for c in rows.columns)):
                if (shard, n) != now:
                    yield from counted()
                    now, held = (shard, n), []
                held.append(Filter.unpacked(blob))
                if len(held) > 1 and sum(map(len, held[1:])) > len(held[0]):  # so each entry is merged a few times only
                    held = [Filter.merged(held)]
        yield from counted()

    shards = filters.repartition("shard").sortWithinPartitions("shard", "n")
    return shards.mapInArrow(run, "n int, w1 long, w2 long, w3 long, w4 long, f long, hash long")


def phrase_counts(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 1 to LONGEST words that occur `least` times (n, w1 to w4, f), the words behind the ids (id, lang, word), and lang, n of all words."""
    words, seed = lossless_words(documents)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    bitmap = frequent_bitmap(frequent.select("id"))
    spread = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * spread, -(-(words.agg(F.sum("f")).first()[0] or 0) // SHARD_WORDS))
    pairs = written(merged_shards(filter_shards(documents, seed, shards, range(2, 3), bitmap), least), "pairs")
    held = frequent_bitmap(pairs.select(F.col("hash").alias("id")))
    longer = written(merged_shards(filter_shards(documents, seed, shards, range(3, LONGEST + 1), bitmap, held), least), "phrases")
    single = frequent.select(F.lit(1).alias("n"), F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]], "f")
    phrases = single.unionByName(pairs.drop("hash")).unionByName(longer.drop("hash"))
    return phrases, frequent.select("id", "lang", "word"), totals




def _part(first: int, size: int) -> Column:
    """The key of `size` words of a row's phrase from place `first` on."""
    return F.struct(*[(F.col(WORDS[first + k]) if k < size else F.lit(0).cast("long")).alias(WORDS[k]) for k in range(LONGEST)])


def _each(made: dict[int, list[Column]]) -> Column:
    """For the phrases of each size an array; an empty one for others."""
    none = F.array().cast(f"array<struct<k:int,a:struct<{','.join(w + ':bigint' for w in WORDS)}>,b:struct<{','.join(w + ':bigint' for w in WORDS)}>>>")
    out = none
    for size, items in made.items():
        out = F.when(F.col("n") == size, F.array(*items)).otherwise(out)
    return out


def scored(phrases: DataFrame) -> DataFrame:
    """n, w1 to w4, a, k, l, r, score of every phrase of two words or more: its lowest-scoring cut, exact."""
    cuts = {size: [F.struct(F.lit(k).alias("k"), _part(0, k).alias("a"), _part(k, size - k).alias("b")) for k in range(1, size)] for size in range(2, LONGEST + 1)}
    rows = phrases.where("n > 1").select("n", *WORDS, F.col("f").alias("a"), F.explode(_each(cuts)).alias("cut"))
    counts = phrases.select(F.struct(*WORDS).alias("key"), "f")
    left, right = counts.select(F.col("key").alias("lk"), F.col("f").alias("l")), counts.select(F.col("key").alias("rk"), F.col("f").alias("r"))
    rows = rows.join(left, F.col("cut.a") == F.col("lk")).join(right, F.col("cut.b") == F.col("rk"))
    score = F.expr("(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = F.min(F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r"))
    return rows.groupBy("n", *WORDS, "a").agg(best.alias("best")).select("n", *WORDS, "a", "best.*")


def not_redundant(candidates: DataFrame, percent: int) -> DataFrame:
    """The candidates that no longer one holds which occurs `percent` % as often."""
    inside = {size: [F.struct(F.lit(0).alias("k"), _part(at, part).alias("a"), _part(at, part).alias("b")) for part in range(2, size) for at in range(size - part + 1)] for size in range(3, LONGEST + 1)}
    held = candidates.where("n > 2").select(F.explode(_each(inside)).alias("p"), "a")
    held = held.groupBy(F.col("p.a").alias("key")).agg(F.max("a").alias("longer"))
    gone = F.coalesce(F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(20,0)) >= CAST({percent} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(20,0))"), F.lit(False))
    return candidates.join(held, F.struct(*WORDS) == F.col("key"), "left").where(~gone).drop("key", "longer")


def collocations(documents: DataFrame, least: int = 30, percent: int = 80, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    phrases, words, totals = phrase_counts(documents, least)
    rows = not_redundant(scored(phrases), percent)
    for k, w in enumerate(WORDS):
        named = words.select(F.col("id").alias(w), F.col("word").alias(f"word{k}"), *([F.col("lang")] if k == 0 else []))
        rows = rows.join(named, w, "inner" if k < 2 else "left")
    phrase = F.concat_ws(" ", *[f"word{k}" for k in range(LONGEST)])  # nulls are left out
    rows = rows.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p
), t AS (
  SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT lang, ws, row_number() OVER () AS piece FROM w)
), q AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)
), f AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, 1 AS size, w1 AS phrase FROM q UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM q UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM q UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM q)
  WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1
), cut AS (
  SELECT lang, size, phrase, a, k, array_to_string(ws[1 : k], ' ') AS part, array_to_string(ws[k + 1 : size], ' ') AS rest FROM c JOIN (VALUES (1), (2), (3)) t(k) ON k < size
), cuts AS (
  SELECT cut.lang, cut.size, cut.phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = part JOIN f y ON y.lang = cut.lang AND y.phrase = rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i : i + part - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (VALUES (2), (3)) s(part), (VALUES (1), (2), (3)) t(i) WHERE part < size AND i + part - 1 <= size
  GROUP BY ALL
), named AS (
  SELECT lang, phrase, a, l, r, score FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
