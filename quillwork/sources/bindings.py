"""The given tables as the logical relations of the two domains.

Each function reads one relation from a directory of Parquet tables; RELATIONS
holds the same mapping as SQL common table expressions for the oracle.
Everything is a column expression over one scan (articles and the request-
service pivot add an explode and an aggregate), so filters and column choices
of the operators reach the Parquet readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, language, type, group, source_file."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("language"),
        F.when(F.col("n_chars") < 500, "NOTE").when(F.col("n_chars") < 2000, "DECREE").otherwise("LAW").alias("type"),
        F.nullif(F.col("source"), F.lit("src0")).alias("group"),
        F.concat(F.lit("laws/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1.txt")).alias("source_file"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, document_id, article_number, text, sort_key, chapter, path, slug, depth, footnotes, synced: a row a line."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    noise = F.element_at(F.array(*[F.lit(x) for x in NOISE]), F.col("pos") % len(NOISE) + 1)
    chapter = F.when(F.col("pos") % 3 != 0, F.concat(F.lit("Chapter "), (F.col("pos") % 7).cast("string")))
    return lines.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("id"),
        F.col("doc_id").alias("document_id"),
        F.when(F.col("pos") == 0, "Preamble").otherwise(F.concat(F.lit("Article "), (F.col("pos") + 1).cast("string"))).alias("article_number"),
        F.concat("line", noise).alias("text"),
        F.col("pos").alias("sort_key"),
        chapter.alias("chapter"),
        F.when(F.col("pos") % 4 == 1, chapter).when(F.col("pos") % 4 > 1, F.concat(F.lit("Book/"), F.col("pos").cast("string"))).alias("path"),
        F.when(F.col("pos") % 5 != 0, F.concat(F.lit("article-"), (F.col("pos") + 1).cast("string"))).alias("slug"),
        F.when(F.col("pos") % 4 != 0, F.col("pos") % 4).alias("depth"),
        F.when(F.col("pos") % 6 == 0, F.concat(F.lit('["first '), F.col("doc_id").cast("string"), F.lit('", {"text": "second"}, {"content": "third"}, {"page": 4}]'))).alias("footnotes"),
        F.when(F.col("doc_id") % 4 != 0, F.lit(True)).alias("synced"),
    )


#: What is put behind lines so that every cleaning step has work: fixed, the same in SQL.
NOISE = ("\n--- PAGE 7 ---", " end12", "\n-15-\n", "\n\n\n\nmore", "\n---\n 3", "\t \uf0b7 ", "")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service requests: one a row of orders."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    free = F.col("o_orderpriority") == "1-URGENT"
    status = F.when((F.col("o_orderstatus") == "P") & free, "pending").when(F.col("o_orderstatus") == "P", "pending_payment").when(F.col("o_orderstatus") == "F", "paid").otherwise("confirmed")
    made = F.col("o_orderdate")
    days = lambda n: made + F.make_dt_interval(n)
    return read(spark, sf_dir, "orders").select(
        o.alias("id"),
        F.lpad(o.cast("string"), 10, "0").alias("ticket_number"),
        F.concat(F.lit("Client "), c.cast("string")).alias("full_name"),
        F.concat(F.lit("c"), c.cast("string"), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("+2126"), F.lpad(c.cast("string"), 8, "0")).alias("phone"),
        F.when(o % 2 == 0, F.concat(F.lit("+2127"), F.lpad(c.cast("string"), 8, "0"))).alias("whatsapp"),
        F.when(o % 3 == 0, "office").when(o % 3 == 1, "whatsapp").alias("consultation_mode"),
        F.when(o % 2 == 0, "bank").otherwise("google_pay").alias("payment_method"),
        F.when(o % 4 != 3, o % 100).alias("service_id"),
        F.when(free, F.lit(0)).when((F.col("o_orderpriority") == "5-LOW") & (o % 10 == 0), None).otherwise(F.col("o_totalprice")).cast(MONEY).alias("base_price"),
        status.alias("status"),
        F.when(c % 5 != 0, c % 10).alias("advisor_id"),
        F.when(made < F.lit("1998-01-01").cast("timestamp_ntz"), "closed").otherwise("open").alias("case_status"),
        F.when((o % 2 == 0) & (o % 3 == 0), F.concat(F.lit("receipts/"), o.cast("string"))).alias("receipt_path"),
        made.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", days(F.lit(1))).alias("paid_at"),
        F.when(F.col("o_orderstatus") == "O", days(F.lit(2))).alias("confirmed_at"),
        F.when(c % 5 != 0, days((o % 30).cast("int"))).alias("last_touched_at"),
    )


#: Rows of lineitem that a task groups, about.
ROWS = 250_000


def request_services(spark: SparkSession, sf_dir: str, rows: int = ROWS) -> DataFrame:
    """request_id, service_id, completed_at: one a pair, however often it is listed.

    More than `rows` rows are dealt by request over so many tasks that each
    gets about as many at most; joins by request go on in these tasks.
    """
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_partkey").alias("service_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("completed_at"),
    )
    tasks = -(-lines.count() // rows)
    if tasks > 1:  # fewer than Spark's own number would be dealt once more by a join
        lines = lines.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "request_id")
    return lines.groupBy("request_id", "service_id").agg(F.min("completed_at").alias("completed_at"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        p.alias("id"),
        F.col("p_name").alias("name_en"),
        F.when(p % 3 != 0, F.concat(F.lit("fr "), "p_name")).alias("name_fr"),
        F.when(p % 2 != 0, F.concat(F.lit("ar "), "p_name")).alias("name_ar"),
        F.when(p % 7 == 0, F.lit(0)).otherwise(F.col("p_retailprice")).cast(MONEY).alias("price"),
        F.when(p % 5 == 0, "").when(p % 5 == 1, "0").when(p % 5 > 2, F.concat(F.lit("from "), p.cast("string"))).alias("price_display_en"),
        F.when(p % 4 == 0, "").when(p % 4 == 1, F.concat(F.lit("dès "), p.cast("string"))).alias("price_display_fr"),
        F.concat(F.lit("about "), "p_name").alias("description_en"),
        F.when(p % 6 == 0, "").when(p % 6 < 4, F.concat(F.lit("sur "), "p_name")).alias("description_fr"),
        F.when(p % 4 != 0, F.col("p_type")).alias("notes_en"),
        F.when(p % 3 == 0, "").when(p % 3 == 1, "0").otherwise(F.concat(F.lit("fr "), "p_type")).alias("notes_fr"),
        F.col("p_brand").alias("additional_notes_en"),
        F.when(p % 5 != 0, F.concat(F.lit("fr "), "p_brand")).alias("additional_notes_fr"),
        (F.col("p_size") % 4 < 2).alias("allows_office"),
        (F.col("p_size") % 4).isin(0, 2).alias("allows_whatsapp"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, email, role, bar: customers, and suppliers as advisors (every seventh as admin)."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    advisors = read(spark, sf_dir, "supplier").select(s.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("a"), s.cast("string"), F.lit("@example.org")).alias("email"), F.when(s % 7 == 6, "admin").otherwise("advisor").alias("role"), F.lit(None).cast("string").alias("bar"))
    clients = read(spark, sf_dir, "customer").select((c + 1000000).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("c"), c.cast("string"), F.lit("@example.org")).alias("email"), F.lit("user").alias("role"), F.when(c % 9 == 0, "").when(c % 9 == 1, "__custom_bar__").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("bar"))
    return advisors.unionByName(clients)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, request_id, user_id, note, created_at: one a click or view event."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 500).alias("request_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 10).alias("user_id"), F.col("event_type").alias("note"), F.col("ts").alias("created_at"))


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, type, intent_id, request_id, amount_cents, currency, method, method_types, failure_code, failure_message."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "payment_intent.succeeded").when(F.col("event_type") == "error", "payment_intent.payment_failed").when(F.col("event_type") == "signup", "payment_intent.canceled").otherwise("other")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id",
        "ts",
        kind.alias("type"),
        F.concat(F.lit("pi_"), F.col("user_id").cast("string")).alias("intent_id"),
        (F.col("user_id") * 10 + k % 3).alias("request_id"),
        F.round(F.col("value").cast("decimal(12,2)") * 100).cast("long").alias("amount_cents"),
        F.when(k % 5 == 0, "MAD").when(k % 5 == 1, "eur").otherwise("mad").alias("currency"),
        F.when(k % 4 != 0, F.concat(F.lit("pm_"), (k % 6).cast("string"))).alias("method"),
        F.when(k % 3 == 0, F.array(F.lit("google_pay"), F.lit("card"))).otherwise(F.array().cast("array<string>")).alias("method_types"),
        F.when(F.col("event_type") == "error", F.when(k % 2 == 0, "card_declined").otherwise("expired_card")).alias("failure_code"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Attempt "), k.cast("string"), F.lit(" failed."))).alias("failure_message"),
    )


_NOISE_SQL = "CASE pos % 7 WHEN 0 THEN chr(10) || '--- PAGE 7 ---' WHEN 1 THEN ' end12' WHEN 2 THEN chr(10) || '-15-' || chr(10) WHEN 3 THEN chr(10) || chr(10) || chr(10) || chr(10) || 'more' WHEN 4 THEN chr(10) || '---' || chr(10) || ' 3' WHEN 5 THEN chr(9) || ' ' || chr(61623) || ' ' ELSE '' END"

#: The relations as SQL, by name.
RELATIONS = {
    "docs": "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, lang AS language, CASE WHEN n_chars < 500 THEN 'NOTE' WHEN n_chars < 2000 THEN 'DECREE' ELSE 'LAW' END AS type, nullif(source, 'src0') AS grp, 'laws/' || source || '/' || doc_id || '.v1.txt' AS source_file FROM documents",
    "lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents",
    "arts": f"SELECT doc_id || '-' || pos AS id, doc_id AS document_id, CASE WHEN pos = 0 THEN 'Preamble' ELSE 'Article ' || (pos + 1) END AS article_number, line || {_NOISE_SQL} AS text, CAST(pos AS INTEGER) AS sort_key, CASE WHEN pos % 3 <> 0 THEN 'Chapter ' || (pos % 7) END AS chapter, CASE WHEN pos % 4 = 1 THEN CASE WHEN pos % 3 <> 0 THEN 'Chapter ' || (pos % 7) END WHEN pos % 4 > 1 THEN 'Book/' || pos END AS path, CASE WHEN pos % 5 <> 0 THEN 'article-' || (pos + 1) END AS slug, CASE WHEN pos % 4 <> 0 THEN CAST(pos % 4 AS INTEGER) END AS depth, CASE WHEN pos % 6 = 0 THEN '[\"first ' || doc_id || '\", {{\"text\": \"second\"}}, {{\"content\": \"third\"}}, {{\"page\": 4}}]' END AS footnotes, CASE WHEN doc_id % 4 <> 0 THEN true END AS synced FROM lines",
    "requests": "SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS ticket_number, 'Client ' || o_custkey AS full_name, 'c' || o_custkey || '@example.org' AS email, '+2126' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS phone, CASE WHEN o_orderkey % 2 = 0 THEN '+2127' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS whatsapp, CASE o_orderkey % 3 WHEN 0 THEN 'office' WHEN 1 THEN 'whatsapp' END AS consultation_mode, CASE WHEN o_orderkey % 2 = 0 THEN 'bank' ELSE 'google_pay' END AS payment_method, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 100 END AS service_id, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(10,2)) AS base_price, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'pending_payment' WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'confirmed' END AS status, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 10 END AS advisor_id, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'closed' ELSE 'open' END AS case_status, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'receipts/' || o_orderkey END AS receipt_path, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS paid_at, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 2 DAY END AS confirmed_at, CASE WHEN o_custkey % 5 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS last_touched_at FROM orders",
    "request_services": "SELECT l_orderkey AS request_id, l_partkey AS service_id, min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS completed_at FROM lineitem GROUP BY ALL",
    "services": "SELECT p_partkey AS id, p_name AS name_en, CASE WHEN p_partkey % 3 <> 0 THEN 'fr ' || p_name END AS name_fr, CASE WHEN p_partkey % 2 <> 0 THEN 'ar ' || p_name END AS name_ar, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(10,2)) AS price, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN '0' WHEN p_partkey % 5 > 2 THEN 'from ' || p_partkey END AS price_display_en, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'dès ' || p_partkey END AS price_display_fr, 'about ' || p_name AS description_en, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 < 4 THEN 'sur ' || p_name END AS description_fr, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS notes_en, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE 'fr ' || p_type END AS notes_fr, p_brand AS additional_notes_en, CASE WHEN p_partkey % 5 <> 0 THEN 'fr ' || p_brand END AS additional_notes_fr, p_size % 4 < 2 AS allows_office, p_size % 4 IN (0, 2) AS allows_whatsapp FROM part",
    "users": "SELECT s_suppkey AS id, s_name AS name, 'a' || s_suppkey || '@example.org' AS email, CASE WHEN s_suppkey % 7 = 6 THEN 'admin' ELSE 'advisor' END AS role, CAST(NULL AS VARCHAR) AS bar FROM supplier UNION ALL SELECT c_custkey + 1000000, c_name, 'c' || c_custkey || '@example.org', 'user', CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 9 = 1 THEN '__custom_bar__' ELSE ' ' || c_mktsegment || ' ' END FROM customer",
    "notes": "SELECT event_id AS id, event_id % 500 AS request_id, CASE WHEN user_id % 3 <> 0 THEN user_id % 10 END AS user_id, event_type AS note, ts AS created_at FROM events WHERE event_type IN ('click', 'view')",
    "payment_events": "SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'payment_intent.succeeded' WHEN 'error' THEN 'payment_intent.payment_failed' WHEN 'signup' THEN 'payment_intent.canceled' ELSE 'other' END AS type, 'pi_' || user_id AS intent_id, user_id * 10 + k % 3 AS request_id, CAST(round(CAST(value AS DECIMAL(12,2)) * 100) AS BIGINT) AS amount_cents, CASE k % 5 WHEN 0 THEN 'MAD' WHEN 1 THEN 'eur' ELSE 'mad' END AS currency, CASE WHEN k % 4 <> 0 THEN 'pm_' || (k % 6) END AS method, CASE WHEN k % 3 = 0 THEN ['google_pay', 'card'] ELSE [] END AS method_types, CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'card_declined' ELSE 'expired_card' END END AS failure_code, CASE WHEN event_type = 'error' THEN 'Attempt ' || k || ' failed.' END AS failure_message FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)",
}
_NEEDS = {"arts": ("lines",)}


def sql(query: str, *relations: str) -> str:
    """A query with the relations that it uses in front; the query may begin with further ones (', x AS (...)')."""
    names = [n for r in relations for n in (*_NEEDS.get(r, ()), r)]
    names = list(dict.fromkeys(names))
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names) + (query if query.lstrip().startswith(",") else f" {query}")
