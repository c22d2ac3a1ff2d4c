"""Payment intents: eligibility, reconciliation, and the state that events leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.pricing import is_free, online_total, to_cents

# Event types and intent states.
SUCCEEDED, FAILED, CANCELED = "payment_intent.succeeded", "payment_intent.payment_failed", "payment_intent.canceled"
STATES = {SUCCEEDED: "succeeded", FAILED: "failed", CANCELED: "canceled"}
REPLACEABLE = ("requires_payment_method", "requires_confirmation", "requires_action")
INTENT_ID = "^pi_[A-Za-z0-9]+$"
LEAST_CENTS = 100
FAILURE = ("failure_code", "failure_message")


def state_of(event_type: Column) -> Column:
    state = F.lit(None).cast("string")
    for kind, name in STATES.items():
        state = F.when(event_type == kind, name).otherwise(state)
    return state


def intent_eligibility(requests: DataFrame, currency: str = "mad") -> DataFrame:
    """id, code, cents, currency: in order, free 422, paid or confirmed 409, no total 422, below 100 cents 422, else 200."""
    cents = to_cents(online_total(F.col("base_price")))
    code = F.when(is_free(F.col("base_price")), 422).when(F.col("status").isin("paid", "confirmed"), 409).when(cents.isNull(), 422).when(cents < LEAST_CENTS, 422).otherwise(200)
    rows = requests.select("id", code.alias("code"), cents.alias("cents"))
    return rows.select("id", "code", F.when(F.col("code") == 200, F.col("cents")).alias("cents"), F.when(F.col("code") == 200, currency).alias("currency"))


def stale_intents(transactions: DataFrame) -> DataFrame:
    """Intents that a new one replaces; one that is processing is not."""
    return transactions.where(F.col("status").isin(*REPLACEABLE))


def reconcile_payments(intents: DataFrame, requests: DataFrame, currency: str = "mad") -> DataFrame:
    """event_id, well_formed, outcome of each intent against its request.

    404 for an unknown ticket, 422 where amount, currency, request id or ticket
    differ, 409 while not succeeded, else 200. intents carry request_id and
    ticket_number from their metadata, and the ticket that was asked for.
    """
    r = requests.select(F.col("id").alias("rid"), F.col("ticket_number").alias("asked_ticket"), to_cents(online_total(F.col("base_price"))).alias("expected"))
    rows = intents.join(r, "asked_ticket", "left")
    same = F.col("amount_cents").eqNullSafe(F.col("expected")) & (F.lower("currency") == currency) & F.col("request_id").eqNullSafe(F.col("rid")) & F.col("ticket_number").eqNullSafe(F.col("asked_ticket"))
    outcome = F.when(F.col("rid").isNull(), 404).when(~F.coalesce(same, F.lit(False)), 422).when(F.col("status") != "succeeded", 409).otherwise(200)
    return rows.select("event_id", F.coalesce(F.col("intent_id").rlike(INTENT_ID), F.lit(False)).alias("well_formed"), outcome.alias("outcome"))


def payment_method_type(intents: DataFrame, methods: DataFrame) -> DataFrame:
    """event_id, method_type: without a method the first allowed type, else its wallet, its type, or card."""
    first = F.get("method_types", F.lit(0))
    rows = intents.join(methods, intents["method"] == methods["method_id"], "left")
    known = F.coalesce("wallet", "kind", F.when(F.col("method_id").isNull(), first), F.lit("card"))
    return rows.select("event_id", F.when(F.col("method").isNull(), F.coalesce(first, F.lit("card"))).otherwise(known).alias("method_type"))


def transactions_latest(events: DataFrame, requests: DataFrame) -> DataFrame:
    """intent_id, status, ever_succeeded after all events, in arrival order.

    An intent begins with a success whose request exists; failures and
    cancellations change only intents that have begun, and a later failure
    replaces a success. Order is (ts, event_id). Where events carry failure_code
    and failure_message, those of the last failure stay.
    """
    known = requests.select(F.col("id").alias("request_id"), F.lit(True).alias("exists"))
    rows = events.withColumn("status", state_of(F.col("type"))).where("status IS NOT NULL").join(known, "request_id", "left")
    at = F.struct("ts", "event_id")
    begins = (F.col("status") == "succeeded") & F.col("exists")
    first = rows.where(begins).groupBy("intent_id").agg(F.min(at).alias("first"))
    failed = [F.max_by(c, F.when(F.col("status") == "failed", at)).alias(c) for c in FAILURE if c in events.columns]
    return rows.join(first, "intent_id").where(at >= F.col("first")).groupBy("intent_id").agg(F.max_by("status", at).alias("status"), F.bool_or(F.col("status") == "succeeded").alias("ever_succeeded"), *failed)


def paid_requests(events: DataFrame, requests: DataFrame) -> DataFrame:
    """id, status, paid_at, receipt_path: a request is paid by its first success, which clears its receipt."""
    wins = events.where(F.col("type") == SUCCEEDED).groupBy("request_id").agg(F.min("ts").alias("won_at"))
    rows = requests.join(wins, requests["id"] == wins["request_id"], "left")
    turns = F.col("won_at").isNotNull() & (F.col("status") != "paid")
    return rows.select("id", F.when(turns, "paid").otherwise(F.col("status")).alias("status"), F.when(turns, F.col("won_at")).otherwise(F.col("paid_at")).alias("paid_at"), F.when(~turns, F.col("receipt_path")).alias("receipt_path"))
