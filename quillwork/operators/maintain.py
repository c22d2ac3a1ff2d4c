"""Whole-table maintenance: backfills, snapshots, deletes, constraints, action logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backfill_free_status(requests: DataFrame, back: bool = False) -> DataFrame:
    """Free requests that wait for payment become pending; back reverses it."""
    old, new = ("pending", "pending_payment") if back else ("pending_payment", "pending")
    return requests.withColumn("status", F.when((F.col("base_price") == 0) & (F.col("status") == old), new).otherwise(F.col("status")))


def snapshot_sync(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The target made to hold just the source's keys: its columns are taken over, others keep their values.

    action says what happened to each row; deleted keys are in the result with
    action 'delete' and null fields.
    """
    given = [c for c in source.columns if c != key]
    kept = [c for c in target.columns if c != key]
    t = target.select(key, F.struct(*kept).alias("old"))
    s = source.select(key, F.struct(*given).alias("new"))
    rows = t.join(s, key, "full_outer")
    there = F.col("new").isNotNull()
    value = lambda c: F.when(there, F.col(f"new.{c}") if c in given else F.col(f"old.{c}")).alias(c)
    action = F.when(~there, "delete").when(F.col("old").isNull(), "insert").otherwise("update")
    return rows.select(key, *[value(c) for c in kept], action.alias("action"))


def cascade_delete(child: DataFrame, parent_key: str, removed: DataFrame) -> DataFrame:
    """The child rows whose parent stays; removed has the column id."""
    return child.join(removed.select(F.col("id").alias(parent_key)), parent_key, "left_anti")


def null_on_delete(rows: DataFrame, reference: str, removed: DataFrame) -> DataFrame:
    """All rows; references to removed ids become null."""
    gone = removed.select(F.col("id").alias("gone")).distinct()
    return rows.join(gone, rows[reference] == gone["gone"], "left").withColumn(reference, F.when(F.col("gone").isNull(), F.col(reference))).drop("gone")


def _row(rule: str, count: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), count.alias("violations")]


#: Rows whose keys a task groups, about.
ROWS = 250_000


def key_counts(table: DataFrame, *keys: str, rows: int | None = ROWS) -> DataFrame:
    """Each key and its number n of rows.

    More than `rows` rows are dealt by key over so many tasks that each gets
    about as many at most. The task that read a row is at first part of its
    key, so that a key that is often repeated is not one task's. Without `rows`
    the table is grouped as it is dealt.
    """
    table = table.select(*keys)
    tasks = -(-table.count() // rows) if rows else 1
    if tasks > 1:
        parts = table.withColumn("reader", F.spark_partition_id()).repartition(tasks, *keys, "reader")
        parts = parts.groupBy(*keys, "reader").agg(F.count("*").alias("n"))
        return parts.repartition(tasks, *keys).groupBy(*keys).agg(F.sum("n").alias("n"))
    return table.groupBy(*keys).agg(F.count("*").alias("n"))


def unique_violations(table: DataFrame, rule: str, *keys: str, rows: int | None = ROWS) -> DataFrame:
    repeated = key_counts(table, *keys, rows=rows).where("n > 1")
    return repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v")).select(*_row(rule, F.col("v")))


def reference_violations(table: DataFrame, rule: str, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    lost = table.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.count("*").alias("v")).select(*_row(rule, F.col("v")))


def row_violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of any number of row rules in one pass."""
    counts = table.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    pairs = F.explode(F.array(*[F.struct(*_row(name, F.col(f"`{name}`"))) for name in rules])).alias("r")
    return counts.select(pairs).select("r.*")


def constraint_report(requests: DataFrame, pairs: DataFrame, services: DataFrame, users: DataFrame) -> DataFrame:
    """rule, violations: keys, references, lengths and domains of the case tables."""
    states = ("pending_payment", "pending", "paid", "confirmed", "rejected")
    rows = row_violations(
        requests,
        {
            "requests.full_name null": F.col("full_name").isNull(),
            "requests.ticket_number length": F.length("ticket_number") > 10,
            "requests.full_name length": F.length("full_name") > 255,
            "requests.email null": F.col("email").isNull(),
            "requests.email length": F.length("email") > 255,
            "requests.phone null": F.col("phone").isNull(),
            "requests.phone length": F.length("phone") > 40,
            "requests.status length": F.length("status") > 20,
            "requests.base_price negative": F.col("base_price") < 0,
            "requests.status domain": ~F.col("status").isin(*states),
            "requests.case_status domain": ~F.col("case_status").isin("open", "closed"),
            "requests.payment_method domain": ~F.col("payment_method").isin("google_pay", "bank"),
        },
    )
    parts = [
        rows,
        unique_violations(requests, "requests.id unique", "id"),
        unique_violations(requests, "requests.ticket_number unique", "ticket_number"),
        unique_violations(pairs, "request_services unique", "request_id", "service_id", rows=None),  # dealt by request
        reference_violations(pairs, "request_services.request_id", "request_id", requests),
        reference_violations(pairs, "request_services.service_id", "service_id", services),
        reference_violations(requests, "requests.advisor_id", "advisor_id", users),
    ]
    return reduce(DataFrame.unionByName, parts)


def length_rules(name: str, columns: dict[str, int | None]) -> dict[str, Column]:
    """Row rules of required columns and greatest lengths: {column: length}, where a '?' behind a column allows null."""
    rules = {}
    for column, most in columns.items():
        c = column.rstrip("?")
        if c == column:
            rules[f"{name}.{c} null"] = F.col(c).isNull()
        if most is not None:
            rules[f"{name}.{c} length"] = F.length(c) > most
    return rules


def corpus_constraints(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """rule, violations: keys, references and lengths of documents and articles."""
    of_documents = length_rules("documents", {"title": 500, "language": 10, "type": 50, "source_file": 500, "group?": 100})
    of_articles = length_rules("articles", {"document_id": None, "article_number": 50, "text": None, "sort_key": None, "path?": 500, "slug?": 500, "chapter?": 500})
    parts = [
        row_violations(documents, of_documents),
        row_violations(articles, of_articles),
        unique_violations(documents, "documents.id unique", "id"),
        unique_violations(articles, "articles.id unique", "id"),
        reference_violations(articles, "articles.document_id", "document_id", documents),
    ]
    return reduce(DataFrame.unionByName, parts)


def people_constraints(users: DataFrame, notes: DataFrame, requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """rule, violations: keys, references and lengths of users, case notes and payment transactions."""
    parts = [
        row_violations(users, length_rules("users", {"name": 255, "email": 255, "role": 20})),
        row_violations(notes, length_rules("notes", {"request_id": None, "note": None})),
        row_violations(transactions, length_rules("transactions", {"request_id": None, "status": 30, "intent_id": 64})),
        unique_violations(users, "users.email unique", "email"),
        unique_violations(transactions, "transactions.intent_id unique", "intent_id"),
        reference_violations(notes, "notes.request_id", "request_id", requests),
        reference_violations(notes, "notes.user_id", "user_id", users),
        reference_violations(transactions, "transactions.request_id", "request_id", requests),
    ]
    return reduce(DataFrame.unionByName, parts)


def service_constraints(services: DataFrame) -> DataFrame:
    """rule, violations: keys, lengths and domains of services; texts that a table doesn't carry have no rule."""
    columns = {f"name_{x}": 255 for x in ("en", "fr", "ar")} | {f"description_{x}?": 1000 for x in ("en", "fr", "ar")}
    columns |= {f"{c}_{x}?": 255 for c in ("price_display", "notes", "additional_notes") for x in ("en", "fr", "ar")}
    columns |= {"price": None, "allows_office": None, "allows_whatsapp": None}
    rules = length_rules("services", {c: most for c, most in columns.items() if c.rstrip("?") in services.columns})
    rules["services.price negative"] = F.col("price") < 0
    return row_violations(services, rules).unionByName(unique_violations(services, "services.id unique", "id"))


def broken_json(column: str) -> Column:
    return F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull()


def payment_constraints(transactions: DataFrame, confirmations: DataFrame, requests: DataFrame) -> DataFrame:
    """rule, violations: keys, references, lengths and domains of payment transactions and of booking confirmations."""
    of_transactions = length_rules("transactions", {"request_id": None, "intent_id": 64, "method?": 64, "currency": 3, "country": 2, "amount_cents": None, "amount": None, "status": 30, "method_type?": 30, "failure_code?": 100})
    of_transactions |= {"transactions.amount_cents negative": F.col("amount_cents") < 0, "transactions.payload json": broken_json("payload")}
    of_confirmations = length_rules("confirmations", {"token": 64, "email": 255, "payload": None, "expires_at": None}) | {"confirmations.payload json": broken_json("payload")}
    parts = [
        row_violations(transactions, of_transactions),
        row_violations(confirmations, of_confirmations),
        unique_violations(transactions, "transactions.intent_id unique", "intent_id"),
        unique_violations(confirmations, "confirmations.token unique", "token"),
        reference_violations(transactions, "transactions.request_id", "request_id", requests),
    ]
    return reduce(DataFrame.unionByName, parts)


def case_state_fold(actions: DataFrame) -> DataFrame:
    """The state that a log of actions leaves in each case.

    actions: case_id, seq, at, action (toggle, claim, close, reopen, other),
    service_id, user_id. A service is completed after an odd number of
    toggles, at the last one; the first claimer stays; the last close or reopen
    decides; every action touches the case.
    """
    is_ = lambda *names: F.col("action").isin(*names)
    turn = F.max_by("action", F.when(is_("close", "reopen"), F.col("seq")))
    cases = actions.groupBy("case_id").agg(
        F.min_by("user_id", F.when(is_("claim"), F.col("seq"))).alias("advisor_id"),
        F.min_by("at", F.when(is_("claim"), F.col("seq"))).alias("first_contact_at"),
        F.when(turn == "close", "closed").otherwise("open").alias("case_status"),
        F.when(turn == "close", F.max_by("at", F.when(is_("close", "reopen"), F.col("seq")))).alias("closed_at"),
        F.max("at").alias("last_touched_at"),
    )
    toggles = actions.where(is_("toggle")).groupBy("case_id", "service_id").agg(F.count("*").alias("n"))
    done = toggles.where("n % 2 = 1").groupBy("case_id").agg(F.count("*").alias("completed"))
    return cases.join(done, "case_id", "left").withColumn("completed", F.coalesce("completed", F.lit(0)))


def case_services(actions: DataFrame) -> DataFrame:
    """case_id, service_id, completed_at: the services that the log leaves completed, each at its last toggle."""
    toggles = actions.where("action = 'toggle'").groupBy("case_id", "service_id").agg(F.count("*").alias("n"), F.max_by("at", "seq").alias("completed_at"))
    return toggles.where("n % 2 = 1").drop("n")


def admin_action_eligibility(requests: DataFrame) -> DataFrame:
    """id, can_confirm, can_reject, can_resend, as the server decides."""
    unpaid, receipt = F.col("status") != "paid", F.col("receipt_path").isNotNull()
    free = F.coalesce(F.col("base_price") == 0, F.lit(False))
    return requests.select("id", (unpaid & (receipt | free)).alias("can_confirm"), (unpaid & receipt).alias("can_reject"), unpaid.alias("can_resend"))
