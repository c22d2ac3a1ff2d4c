"""Batch intake of bookings: phones, validation, consultation modes, pricing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats and domains of a booking.
PHONE = r"^\+?[1-9][0-9]{8,14}$"
EMAIL = r"^[^@\s]+@[^@\s]+$"
MODES = ("office", "whatsapp")
METHODS = ("google_pay", "bank")
PAYLOAD = "full_name string, email string, phone string, whatsapp string, case_description string, service_ids array<bigint>, consultation_mode string, call_time string, payment_method string, locale string"


def booking_payload_scan(confirmations: DataFrame) -> DataFrame:
    """Confirmations with their JSON payload's fields beside them."""
    return confirmations.withColumn("p", F.from_json("payload", PAYLOAD)).select(*[c for c in confirmations.columns if c != "payload"], "p.*")


def normalize_phone(phone: Column) -> Column:
    return F.regexp_replace(F.btrim(phone, F.lit(" \t\n\r\0\x0b")), "[^0-9+]", "")


def validate_bookings(bookings: DataFrame, services: DataFrame) -> DataFrame:
    """id, errors: the codes of the rules that each booking breaks, in the order of the rules.

    call_time is checked where bookings carry it; rules that depend on the
    services chosen are those of `conditional_errors`.
    """
    ids = bookings.select("id", F.explode("service_ids").alias("service_id"))
    unknown = ids.join(services.select(F.col("id").alias("service_id")), "service_id", "left_anti").select("id").distinct().withColumn("unknown", F.lit(True))
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    phone = lambda c: ~F.coalesce(normalize_phone(F.col(c)).rlike(PHONE), F.lit(False))
    rules = {
        "full_name": missing("full_name") | (F.length("full_name") > 255),
        "email": missing("email") | (F.length("email") > 255) | ~F.col("email").rlike(EMAIL),
        "phone": phone("phone"),
        "whatsapp": F.col("whatsapp").isNotNull() & phone("whatsapp"),
        "case_description": missing("case_description") | (F.length("case_description") > 5000),
        "service_ids": F.col("service_ids").isNull() | (F.size("service_ids") == 0),
        "service_ids.distinct": F.size(F.array_distinct("service_ids")) < F.size("service_ids"),
        "service_ids.exists": F.col("unknown"),
        "consultation_mode": F.col("consultation_mode").isNotNull() & ~F.col("consultation_mode").isin(*MODES),
        "payment_method": F.col("payment_method").isNotNull() & ~F.col("payment_method").isin(*METHODS),
    }
    if "call_time" in bookings.columns:
        rules["call_time"] = F.length("call_time") > 20
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules.items()]))
    return bookings.join(unknown, "id", "left").select("id", F.array_join(codes, ",").alias("errors"))


def service_modes(services: DataFrame) -> DataFrame:
    """id, modes: office and whatsapp as allowed, in that order; none allowed means whatsapp."""
    return services.select("id", F.array_join(modes_of(F.col("allows_office"), F.col("allows_whatsapp")), ",").alias("modes"))


def modes_of(office: Column, whatsapp: Column) -> Column:
    allowed = F.array_compact(F.array(F.when(office, "office"), F.when(whatsapp, "whatsapp")))
    return F.when(F.size(allowed) == 0, F.array(F.lit("whatsapp"))).otherwise(allowed)


def common_modes(pairs: DataFrame, services: DataFrame, empty_modes: str = "whatsapp") -> DataFrame:
    """request_id, modes: what all services of a request allow.

    A service without modes allows whatsapp; with empty_modes='ignore' it is
    left out of the intersection instead.
    """
    rows = pairs.join(services.select(F.col("id").alias("service_id"), "allows_office", "allows_whatsapp"), "service_id")
    if empty_modes == "ignore":
        none = ~F.col("allows_office") & ~F.col("allows_whatsapp")
        rows = rows.withColumn("allows_office", F.col("allows_office") | none).withColumn("allows_whatsapp", F.col("allows_whatsapp") | none)
    else:
        rows = rows.withColumn("allows_whatsapp", F.col("allows_whatsapp") | ~F.col("allows_office"))
    both = rows.groupBy("request_id").agg(F.bool_and("allows_office").alias("office"), F.bool_and("allows_whatsapp").alias("whatsapp"))
    return both.select("request_id", F.array_compact(F.array(F.when(F.col("office"), "office"), F.when(F.col("whatsapp"), "whatsapp"))).alias("modes"))


def requirements(pairs: DataFrame, services: DataFrame) -> DataFrame:
    """request_id, mode_required, payment_required."""
    prices = pairs.join(services.select(F.col("id").alias("service_id"), "price"), "service_id").groupBy("request_id").agg(F.sum("price").alias("total"))
    return common_modes(pairs, services).join(prices, "request_id").select("request_id", (F.size("modes") > 0).alias("mode_required"), (F.col("total") > 0).alias("payment_required"))


def conditional_errors(bookings: DataFrame, services: DataFrame) -> DataFrame:
    """id, errors: the codes of the rules that hold because of the services chosen.

    Where the known services share a mode, a mode is required and has to be one
    that they share; where their sum is above 0, a method is required. A booking
    without a known service breaks none.
    """
    pairs = request_service_rows(bookings, services)
    prices = pairs.join(services.select(F.col("id").alias("service_id"), "price"), "service_id").groupBy("request_id").agg(F.sum("price").alias("total"))
    asked = common_modes(pairs, services).join(prices, "request_id")
    mode, shared, none = F.col("consultation_mode"), F.size("modes") > 0, lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = {
        "consultation_mode.required": shared & none("consultation_mode"),
        "consultation_mode.allowed": shared & (mode != "") & ~F.array_contains("modes", mode),
        "payment_method.required": (F.col("total") > 0) & none("payment_method"),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules.items()]))
    return bookings.join(asked, bookings["id"] == asked["request_id"], "left").select("id", F.array_join(codes, ",").alias("errors"))


def confirmation_state(expires_at: Column, confirmed_at: Column, exists: Column, now: Column) -> Column:
    """invalid if missing or used, expired without or after its time, else ok; in that order."""
    return F.when(~exists | confirmed_at.isNotNull(), "invalid").when(expires_at.isNull() | (expires_at < now), "expired").otherwise("ok")


def expire_confirmations(confirmations: DataFrame, hours: int = 24) -> DataFrame:
    return confirmations.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(hours)))


def request_service_rows(bookings: DataFrame, services: DataFrame) -> DataFrame:
    """request_id, service_id: the known services of each booking, once each."""
    ids = bookings.select(F.col("id").alias("request_id"), F.explode(F.array_distinct("service_ids")).alias("service_id"))
    return ids.join(services.select(F.col("id").alias("service_id")), "service_id", "left_semi").select("request_id", "service_id")


def book_requests(bookings: DataFrame, services: DataFrame) -> DataFrame:
    """One request a booking with at least one known service.

    The base price is the sum; the first service is the smallest id; the mode
    stays only if all services allow it; an absent or unknown payment method
    becomes google_pay; free requests wait, others wait for payment.
    """
    pairs = request_service_rows(bookings, services)
    sums = pairs.join(services.select(F.col("id").alias("service_id"), "price"), "service_id").groupBy("request_id").agg(F.sum("price").cast("decimal(10,2)").alias("base_price"), F.min("service_id").alias("service_id"))
    rows = bookings.join(sums, bookings["id"] == sums["request_id"]).join(common_modes(pairs, services), "request_id")
    mode = F.when(F.array_contains("modes", F.col("consultation_mode")), F.col("consultation_mode"))
    method = F.when(F.col("payment_method").isin(*METHODS), F.col("payment_method")).otherwise(METHODS[0])
    status = F.when(F.col("base_price") == 0, "pending").otherwise("pending_payment")
    return rows.select("id", "base_price", "service_id", mode.alias("consultation_mode"), method.alias("payment_method"), status.alias("status"))
