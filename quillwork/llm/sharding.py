"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws
-ln(u) / weight, u being a hash of the child's name and the document's id, and
the smallest draw wins. A child's draw depends on nothing but its own name,
its weight and the id, so a changed weight moves documents only into or out of
the subtree whose weight changed. `grown` puts each added shard into a region
of its own: no other subtree's weight changes, so documents move only into the
new shard.

Edge cases: a null id hashes as the text 'null' (such rows share a shard); a
null text has size 1 and crc32 0; repeated rows stay separate rows; an empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.shared import table, written

#: {parent: [(child, weight), ...]}; a leaf is "s<number of the shard>".
Tree = dict[str, list[tuple[str, float]]]
ROOT, LEVELS = "root", 3
#: Digits of md5 that make a draw: 52 bits, exact in a double.
DIGITS, RANGE = 13, float(16**13)


def base_tree(shards: int, per_rack: int = 2, per_region: int = 4, weights: dict[int, float] | None = None) -> Tree:
    """Shards dealt to racks and racks to regions, in order; weight 1 unless given."""
    tree: Tree = {}
    for s in range(shards):
        region, rack = f"r{s // per_region}", f"r{s // per_region}k{s // per_rack}"
        tree.setdefault(ROOT, [])
        if region not in tree:
            tree[region] = []
        if rack not in tree:
            tree[rack] = []
            tree[region].append((rack, 0.0))
        tree[rack].append((f"s{s}", (weights or {}).get(s, 1.0)))
    regions = [n for n in tree if n != ROOT and "k" not in n]
    for region in regions:
        tree[region] = [(rack, sum(w for _, w in tree[rack])) for rack, _ in tree[region]]
    tree[ROOT] = [(region, sum(w for _, w in tree[region])) for region in regions]
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a rack and a region of its own."""
    region, rack = f"x{shard}", f"x{shard}k0"
    return {**tree, ROOT: [*tree[ROOT], (region, weight)], region: [(rack, weight)], rack: [(f"s{shard}", weight)]}


def _draw(child: Column, key: Column) -> Column:
    digits = F.substring(F.md5(F.concat(child, F.lit(":"), key).cast("binary")), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(RANGE)
    return -F.log(u)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key (a string column) under a tree."""
    if not tree:
        raise ValueError("the tree has no shard")
    entries = []
    for parent, children in tree.items():
        entries += [F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in children if w > 0])]
    children_of = F.create_map(*entries)
    node = F.lit(ROOT)
    for _ in range(LEVELS):
        draws = F.transform(children_of[node], lambda c: F.struct((_draw(c["name"], key) / c["weight"]).alias("draw"), c["name"].alias("name")))
        node = F.array_min(draws)["name"]
    return F.substring(node, 2, 20).cast("int")


def assign_shards(documents: DataFrame, shards: int = 8, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row a document.

    slot numbers a shard's rows from 0 in the order of doc_id. Rows are counted
    a partition and shard at a time; only these counts are summed up, so no
    task holds a whole shard.
    """
    tree = base_tree(shards, weights=weights)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown(tree, shards)).alias("grown_shard"),
    )
    rows = written(rows, "shard-rows")  # the texts are read once; what follows moves 32 bytes a row
    order = ["doc_id", "text_crc32", "size", "row"]  # dealt by row at last: one id's rows need not lie in one partition
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ordered.drop("row").withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "shard-order")
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("part", "shard").orderBy("seq")
    return (
        placed.withColumn("local", F.row_number().over(local) - 1)
        .join(offsets, ["part", "shard"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("local")).cast("long").alias("slot"), "grown_shard")
    )


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def _tree_sql(tree: Tree, name: str) -> str:
    """A tree as SQL: name.node, name.child, name.weight."""
    rows = ", ".join(f"('{parent}', '{child}', CAST({weight} AS DOUBLE))" for parent, children in tree.items() for child, weight in children if weight > 0)
    return f"{name}(node, child, weight) AS (VALUES {rows})"


def _descent_sql(tree: str, name: str) -> str:
    """Every document's shard under a tree, a level at a time."""
    steps = [f"{name}0 AS (SELECT DISTINCT key, '{ROOT}' AS node FROM d)"]
    for n in range(LEVELS):
        draw = f"-ln((CAST('0x' || substr(md5(child || ':' || key), 1, {DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {RANGE}::DOUBLE) / weight"
        steps.append(f"{name}{n + 1} AS (SELECT key, arg_min(child, ({draw}, child)) AS node FROM {name}{n} JOIN {tree} USING (node) GROUP BY key)")
    return ", ".join(steps)


OP6_SQL = f"""
WITH {_tree_sql(base_tree(8), "tree")}, {_tree_sql(grown(base_tree(8), 8), "more")},
crc(t) AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END))),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, coalesce(octet_length(encode(text)), 0) + 1 AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes FROM documents),
{_descent_sql("tree", "a")}, {_descent_sql("more", "b")},
p AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda x, y: xor(x >> 8, t[CAST((xor(x, y) & 255) + 1 AS INTEGER)]))) AS text_crc32, CAST(substr(a{LEVELS}.node, 2) AS INTEGER) AS shard, CAST(substr(b{LEVELS}.node, 2) AS INTEGER) AS grown_shard FROM d JOIN a{LEVELS} USING (key) JOIN b{LEVELS} USING (key), crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM p
"""
