"""Jobs that the domain names without defining them: vector search, page text, chunks, categories."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.entities import html5, name2codepoint

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_SCORE, CANDIDATES, RESULTS = 0.55, 2000, 12
#: Vectors a block (64 components of 8 bytes: 2 MB), and queries multiplied at once.
BLOCK, SLAB = 4096, 128
#: Words of 64 bits, at most, of the filter in front of a join with a dictionary: 8 MB of bits.
FILTER = 1 << 20
#: Terms of a dictionary that are broadcast, about 130 bytes each, so that their runs are counted where they are found.
HELD = 500_000
#: Phrases of one number of words that a pattern names, rather than all runs of so many words being tried.
FEW = 100
#: What no run of words has: other characters than letters, digits and single spaces between them.
NO_RUN = r"[^\p{L}\p{N} ]|^ |  | \z|^\z"
ARTICLE = r"(?i)\b(?:article|artikel|artículo|art\.)\s+(\d+)"
LAW = r"(?i)\b(?:law|loi|gesetz|ley)\s+(?:no\.?\s*)?(\d+[-/.]\d+)"
DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
# Words that speak for a category.
KEYWORDS = {"banking": ("bank", "loan"), "tax": ("tax", "duty"), "family": ("the", "and"), "civil": ("de", "la"), "labor": ("der", "die"), "real-estate": ("que", "el")}


def _usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (of length 1, in doubles), width of the vectors that have a direction."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    vectors = embeddings.select("vec_id", x.alias("x"), norm.alias("norm")).where((F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < F.lit(float("inf"))))
    return vectors.select("vec_id", F.transform("x", lambda v: v / F.col("norm")).alias("x"), F.size("x").alias("width"))


def best_of_block(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, least: float, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, scores) of each query's best `most` vectors of a block, itself not counted; scores at least `least`.

    Vectors have length 1. The first half of the components gives a product and,
    with the lengths of what is left, a bound; only vectors whose bound reaches
    the queries' least score are multiplied on.
    """
    half = queries.shape[1] // 2
    rest_q, rest_v = (np.sqrt(np.maximum((m[:, half:] ** 2).sum(1), 0)) for m in (queries, vectors))
    for a in range(0, len(queries), SLAB):
        q = queries[a : a + SLAB]
        scores = q[:, :half] @ vectors[:, :half].T
        bound = scores + np.outer(rest_q[a : a + SLAB], rest_v)
        live = np.flatnonzero((bound >= least - 1e-6).any(axis=0))
        scores = scores[:, live] + q[:, half:] @ vectors[live, half:].T
        for k, row in enumerate(np.floor(scores * 1e6 + 0.5)):  # by rounded score, then id, as they are ranked
            found = np.flatnonzero((row >= np.floor(least * 1e6)) & (ids[live] != own[a + k]))
            if len(found) > most:
                edge = -np.partition(-row[found], most - 1)[most - 1]
                found = found[row[found] >= edge]
                found = found[np.lexsort((ids[live[found]], -row[found]))[:most]]
            if len(found):
                yield a + k, ids[live[found]], scores[k, found]


def _matched(key: tuple, left: pa.Table, right: pa.Table, least: float, most: int) -> pa.Table:
    """The pairs of a block of queries and a block of vectors."""
    out: list[list] = [[], [], []]
    if left.num_rows and right.num_rows:
        (own, q), (ids, v) = ((np.asarray(t.column(0)), np.asarray(t.column(1).combine_chunks().flatten()).reshape(t.num_rows, -1)) for t in (left.select(["vec_id", "x"]), right.select(["vec_id", "x"])))
        for row, found, scores in best_of_block(q, v, ids, own, least, most):
            out[0].append(np.full(len(found), own[row]))
            out[1].append(found)
            out[2].append(scores)
    kinds = (np.int64, np.int64, np.float64)
    return pa.table({n: pa.array(np.concatenate(c).astype(k) if c else np.zeros(0, k)) for n, c, k in zip(("query_id", "vec_id", "score"), out, kinds)})


def semantic_topk(embeddings: DataFrame, every: int = 50, min_score: float = MIN_SCORE, results: int = RESULTS, candidate_limit: int = CANDIDATES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the most similar vectors of each query by cosine, at least min_score.

    Queries are the vectors whose id is divisible by `every`; of each at most
    `candidate_limit` candidates are ranked and `results` given. Queries and
    vectors are dealt into blocks of about `block`; each pair of blocks is one
    cogrouped matrix product, so the plan is the same for any number of either,
    nothing is broadcast, and a task holds two blocks. Vectors of other lengths
    than a query's, and vectors that are null or hold a null, NaN or infinite
    component, take no part.
    """
    vectors = _usable(embeddings)
    n, asked = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    many, few = max(1, -(-n // block)), max(1, -(-asked // block))
    dealt = lambda of: F.pmod(F.xxhash64("vec_id", "x"), F.lit(of))
    copied = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    queries = vectors.where(F.col("vec_id") % every == 0).select("width", dealt(few).alias("q"), copied(many).alias("v"), "vec_id", "x")
    rows = vectors.select("width", dealt(many).alias("v"), copied(few).alias("q"), "vec_id", "x")
    most = min(results, candidate_limit)
    keys = ("width", "q", "v")
    pairs = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(lambda key, left, right: _matched(key, left, right, min_score, most), "query_id long, vec_id long, score double")
    scored = pairs.withColumn("score", F.round("score", 6)).where(F.col("score") >= min_score)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
#: Character references by name: those of HTML 4 and the apostrophe, as HTML 5 resolves them, from Python's tables; and the code points that pages mean as Windows-1252.
NAMED = {f"&{name};": html5[f"{name};"] for name in [*sorted(name2codepoint), "apos"]}
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore")}


def _table(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _character(point: Column) -> Column:
    """The character of a code point; what is none, or half of one, is the replacement character."""
    wrong = point.isNull() | (point <= 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    safe = F.when(wrong, 0xFFFD).otherwise(point)
    return F.coalesce(F.try_element_at(_table(WINDOWS), safe.cast("int")), F.decode(F.unhex(F.lpad(F.hex(safe.cast("long")), 8, "0")), "UTF-32"))


def _referred(reference: Column) -> Column:
    """What one reference stands for; an unknown name stays as it is."""
    digits = F.regexp_extract(reference, "([0-9a-fA-F]+);", 1)
    trimmed = F.ltrim(digits, F.lit("0"))
    hexadecimal = F.lower(F.substring(reference, 1, 3)) == "&#x"
    small = F.length(trimmed) <= 8  # longer ones are no code points
    point = F.when(small & hexadecimal, F.conv(digits, 16, 10).cast("long")).when(small & ~hexadecimal, digits.cast("long"))
    return F.when(F.startswith(reference, F.lit("&#")), _character(point)).otherwise(F.coalesce(F.try_element_at(_table(NAMED), reference), reference))


def unescaped(text: Column) -> Column:
    """The text with its character references (by name, number or hexadecimal number) resolved, each once: an escaped reference stays one."""
    between = F.split(text, REFERENCE, -1)
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _referred), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def page_text(html: Column) -> Column:
    """A page's text: scripts, styles and comments gone, tags as line ends, references resolved, space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    text = F.replace(unescaped(text), F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def extract_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", page_text(F.col("html")).alias("text"))


def chunk_documents(documents: DataFrame, most: int = 1000) -> DataFrame:
    """doc_id, chunk, text: paragraphs packed by where they begin, `most` characters a chunk.

    A document is a row: rows that share an id, or have none, are chunked each
    for itself and spread over tasks by their texts; repeated rows give their
    chunks as often. A null text has no chunk, an empty one an empty chunk.
    """
    row = ("doc_id", "row")
    texts = documents.select("doc_id", F.sha2("text", 256).alias("row"), "text").groupBy(*row).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    lines = texts.select(*row, "copies", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    running = Window.partitionBy(*row).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(running), F.lit(0))
    lines = lines.select(*row, "copies", "pos", "line", F.floor(start / most).alias("chunk"))
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    chunks = lines.groupBy(*row, "chunk").agg(packed.alias("text"), F.max("copies").alias("copies"))
    return chunks.select("doc_id", "chunk", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")


def parse_references(texts: DataFrame, key: str) -> DataFrame:
    """key, kind, n, value: article numbers, law numbers and dates named in a text."""
    kinds = [("article", ARTICLE), ("law", LAW), ("date", DATE)]
    found = F.flatten(F.array(*[_named(kind, pattern) for kind, pattern in kinds]))
    return texts.select(key, F.explode(found).alias("f")).select(key, "f.*")


def _named(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda v, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("n"), v.alias("value")))


def categorize(documents: DataFrame, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> DataFrame:
    """doc_id, category, score: the category whose words occur most; ties by name; none below one.

    keywords: the lower-case words that speak for each category.
    """
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    table = F.create_map(*[F.lit(x) for c, ws in sorted(keywords.items()) for w in ws for x in (w, c)])
    spoken = documents.select("doc_id", F.explode(words).alias("word")).where(F.col("word").isin(*[w for ws in keywords.values() for w in ws]))
    counts = spoken.groupBy("doc_id", F.element_at(table, F.col("word")).alias("category")).agg(F.count("*").alias("score"))
    first = F.min_by(F.struct("category", "score"), F.struct((-F.col("score")).alias("s"), "category"))
    return counts.groupBy("doc_id").agg(first.alias("m")).select("doc_id", "m.category", "m.score")


def phrases_of(text: Column, longest: int, few: dict[int, list[str]] | None = None) -> Column:
    """All runs of 1 to `longest` words of a text, in lower case, joined by spaces; each length is one pass over the text.

    few: by number of words, the only runs that are asked for.
    """
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    named = {n: "|".join(runs) for n, runs in (few or {}).items()}
    asked = [n for n in range(1, longest + 1) if named.get(n) != ""]
    patterns = [r"(?<![^ ])(?=(%s)(?![^ ]))" % named.get(n, "[^ ]+(?: [^ ]+){%d}" % (n - 1)) for n in asked]
    return F.concat(*[F.regexp_extract_all(plain, F.lit(p), F.lit(1)) for p in patterns]) if asked else F.array().cast("array<string>")


def perhaps_in(rows: DataFrame, others: DataFrame, column: str, words: int = FILTER) -> DataFrame:
    """The rows whose value is among the others' values, and a few more: those whose three bits of a word of 64 are set in a filter of `words` words.

    The filter has a fixed greatest size, so it can be broadcast; a join for the
    exact rows has to follow, and finds less to shuffle.
    """
    hashed = F.xxhash64(column)
    word = F.pmod(hashed, F.lit(words))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(63)).cast("int"))
    bits = one(40).bitwiseOR(one(48)).bitwiseOR(one(56))
    held = others.select(word.alias("word"), bits.alias("mask"))
    filled = F.broadcast(held.groupBy("word").agg(F.bit_or("mask").alias("mask")))  # at most `words` rows
    return rows.join(filled, (word == F.col("word")) & (F.col("mask").bitwiseAND(bits) == bits), "left_semi")


def near_and_far(terms: DataFrame, held: int) -> tuple[DataFrame, DataFrame | None, dict[int, int]]:
    """The terms that are broadcast, at most `held`; the others, if any; the number of terms by their words.

    Phrases with more terms go first, as texts hold them more often; phrases
    with equally many go by hash.
    """
    most, parts = 64, 1024
    entries = F.least(F.count("*").over(Window.partitionBy("phrase")), F.lit(most))
    ranked = terms.withColumn("place", (entries * parts + F.pmod(F.xxhash64("phrase"), F.lit(parts))).cast("int"))
    sizes = ranked.groupBy("place", _words("phrase").alias("words")).agg(F.count("*").alias("n")).collect()  # at most 65 * 1024 rows for each number of words
    by_words, by_place = Counter(), Counter()
    for r in sizes:
        by_words[r.words] += r.n
        by_place[r.place] += r.n
    total, cut = 0, (most + 1) * parts
    for place in sorted(by_place, reverse=True):
        total += by_place[place]
        if total > held:
            return ranked.where(F.col("place") >= cut).drop("place"), ranked.where(F.col("place") < cut).drop("place"), by_words
        cut = place
    return terms, None, by_words


def _words(phrase: str) -> Column:
    return F.size(F.split(phrase, " "))


def categorize_by(documents: DataFrame, dictionary: DataFrame, most: int = 1, held: int = HELD) -> DataFrame:
    """doc_id, rank, category, score: the categories whose phrases weigh most in a text.

    dictionary: phrase (words in lower case, by single spaces), category,
    weight, and perhaps language, which then has to be the document's lang; a
    null language holds for all. A phrase counts as often as it occurs. Runs of
    words that the dictionary can't hold go where they are found. Up to `held`
    terms are broadcast, and their runs are summed by category where they are
    found; only the runs that may be of further terms are shuffled to be joined.
    Where few phrases have so many words, only their own runs are taken from a
    text. Ties go by name; categories below zero or at zero are left out; nulls
    of phrase, category or weight say nothing.
    """
    by_language = "language" in dictionary.columns
    own = ["doc_id", *(["lang"] if by_language else [])]
    entry = ["category", "weight", *(["language"] if by_language else [])]
    terms = dictionary.where("phrase IS NOT NULL AND category IS NOT NULL AND weight IS NOT NULL").where(~F.rlike("phrase", F.lit(NO_RUN))).select("phrase", *entry)
    near, far, by_words = near_and_far(terms, held)
    longest = max(by_words, default=0)
    few = {n: [] for n in range(1, longest + 1) if by_words[n] <= FEW}
    for r in terms.where(_words("phrase").isin(*few)).select("phrase").distinct().collect() if few else []:
        few[len(r.phrase.split(" "))].append(r.phrase)
    runs = documents.select(*own, F.explode(phrases_of(F.col("text"), longest, few)).alias("phrase"))
    found = perhaps_in(runs, near, "phrase").join(F.broadcast(near), "phrase")
    if far is not None:  # texts are read once more: runs of both kinds in one pass would be shuffled twice
        found = found.unionByName(perhaps_in(runs, far, "phrase").join(far, "phrase"))
    if by_language:
        found = found.where(F.col("language").isNull() | (F.col("language") == F.col("lang")))
    scores = found.groupBy("doc_id", "category").agg(F.sum(F.lit(1).cast("long") * F.col("weight")).alias("score")).where("score > 0")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "category", "score"))), 1, most)  # as many as there are categories
    ranked = scores.groupBy("doc_id").agg(best.alias("best")).select("doc_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("doc_id", (F.col("at") + 1).alias("rank"), "b.category", "b.score")
