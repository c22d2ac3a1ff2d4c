"""Queries of pricing and booking over the bound tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators import booking as K
from quillwork.operators import pricing as P
from quillwork.sources import bindings as B
from quillwork.sources.bindings import sql

URL = "https://pay.example.org/link"


def bookings(s, d):
    """Bookings with the services listed for an order; every thirteenth lists an unknown one too."""
    r, o = B.requests(s, d), F.col("id")
    lists = B.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sort_array(F.collect_list("l_partkey")).alias("listed"))
    listed = F.coalesce("listed", F.array().cast("array<bigint>"))
    rows = r.join(lists, r["id"] == lists["order_id"], "left")
    return rows.select(
        "id",
        F.when(o % 17 != 0, F.col("full_name")).alias("full_name"),
        F.when(o % 19 == 0, "nobody").otherwise(F.col("email")).alias("email"),
        F.when(o % 23 == 0, "12 34").otherwise(F.concat(F.lit(" +212 "), F.substring("phone", 5, 20), F.lit("-"))).alias("phone"),
        "whatsapp",
        F.col("status").alias("case_description"),
        F.when(o % 13 == 0, F.concat(listed, F.array(F.lit(-1).cast("long")))).otherwise(listed).alias("service_ids"),
        F.when(o % 29 == 0, "phone").otherwise(F.col("consultation_mode")).alias("consultation_mode"),
        F.when(o % 31 == 0, "cash").when(o % 31 == 1, None).otherwise(F.col("payment_method")).alias("payment_method"),
        F.when(o % 37 == 0, "any time before noon or after six").when(o % 3 == 0, "before noon").alias("call_time"),
    )


_BOOK = """, listed AS (SELECT l_orderkey AS order_id, list_sort(list(l_partkey)) AS listed FROM lineitem GROUP BY l_orderkey),
bookings AS (SELECT id, CASE WHEN id % 17 <> 0 THEN full_name END AS full_name, CASE WHEN id % 19 = 0 THEN 'nobody' ELSE email END AS email,
  CASE WHEN id % 23 = 0 THEN '12 34' ELSE ' +212 ' || phone[5:] || '-' END AS phone, whatsapp, status AS case_description,
  CASE WHEN id % 13 = 0 THEN list_append(coalesce(listed, []), -1) ELSE coalesce(listed, []) END AS service_ids,
  CASE WHEN id % 29 = 0 THEN 'phone' ELSE consultation_mode END AS consultation_mode,
  CASE WHEN id % 31 = 0 THEN 'cash' WHEN id % 31 = 1 THEN NULL ELSE payment_method END AS payment_method,
  CASE WHEN id % 37 = 0 THEN 'any time before noon or after six' WHEN id % 3 = 0 THEN 'before noon' END AS call_time
  FROM requests LEFT JOIN listed ON id = order_id),
pairs AS (SELECT DISTINCT b.id AS request_id, u.service_id FROM bookings b, (SELECT id, unnest(service_ids) AS service_id FROM bookings) u WHERE u.id = b.id AND u.service_id IN (SELECT id FROM services)),
modes AS (SELECT request_id, sum(s.price) AS total, min(service_id) AS first, bool_and(allows_office) AS office, bool_and(allows_whatsapp OR NOT allows_office) AS whatsapp FROM pairs p JOIN services s ON p.service_id = s.id GROUP BY request_id)"""
_STAMP = "TIMESTAMP '1998-06-01'"


def _confirmations(s, d):
    """Confirmations with a JSON payload, one a request."""
    r, o = B.requests(s, d), F.col("id")
    payload = F.to_json(F.struct("full_name", "email", "phone", F.array(o % 100, o % 7).alias("service_ids"), F.col("payment_method")))
    return r.select("id", F.col("created_at"), F.when(o % 5 == 0, F.col("created_at")).alias("confirmed_at"), F.when(o % 11 != 0, F.col("created_at") + F.make_dt_interval(F.lit(300))).alias("expires_at"), payload.alias("payload"))


def confirmation_events(s, d):
    """What happens to the table's confirmations: each is created for 24 hours (some without an end, some never), and tried up to twice."""
    r, o = B.requests(s, d), F.col("id")
    hours = lambda n: F.col("created_at") + F.make_dt_interval(F.lit(0), n.cast("int"))
    event = lambda kind, attempt, at, ends: F.struct(F.lit(kind).alias("kind"), attempt.cast("long").alias("attempt_id"), at.alias("at"), ends.cast("timestamp_ntz").alias("expires_at"))
    made = F.when(o % 37 != 0, event("created", F.lit(None), F.col("created_at"), F.when(o % 11 != 0, hours(F.lit(24)))))
    first = F.when(o % 3 != 0, event("confirm", o * 2, hours(o % 40), F.lit(None)))
    second = F.when(o % 6 == 1, event("confirm", o * 2 + 1, hours(o % 40 + 1), F.lit(None)))
    return r.select(o.alias("token"), F.explode(F.array_compact(F.array(made, first, second))).alias("e")).select("token", "e.*")


def _req(f):
    return lambda s, d: f(B.requests(s, d))


def _svc(f):
    return lambda s, d: f(B.services(s, d))


def _state(s, d):
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    state = K.confirmation_state(F.col("expires_at"), F.col("confirmed_at"), F.col("id") % 37 != 0, now)
    return _confirmations(s, d).select("id", state.alias("state"))


def _pairs(s, d):
    return K.request_service_rows(bookings(s, d), B.services(s, d))


def _common(s, d):
    rows = K.common_modes(_pairs(s, d), B.services(s, d))
    return rows.select("request_id", F.array_join("modes", ",").alias("modes"))


QUERIES = {
    "online_total": _req(lambda r: P.totals(r).select("id", "online_total")),
    "bank_total": _req(lambda r: P.totals(r).select("id", "bank_total")),
    "payable_total": _req(lambda r: P.totals(r).select("id", "payable_total")),
    "is_free": _req(lambda r: P.totals(r).select("id", "is_free")),
    "to_cents": _req(lambda r: P.totals(r).select("id", "online_cents")),
    "service_catalog": _svc(P.service_catalog),
    "localized_services": _svc(lambda v: P.localized_services(v, "fr").select("id", "name", "description", "notes", "additional_notes", "price_display")),
    "price_label": _svc(lambda v: P.localized_services(v, "en").select("id", "price_label")),
    "surcharge_lines": _req(P.surcharge_lines),
    "payment_route": _req(lambda r: P.payment_route(r, URL)),
    "booking_payload_scan": lambda s, d: K.booking_payload_scan(_confirmations(s, d)).select("id", "full_name", "email", "payment_method", F.element_at("service_ids", 1).alias("first_service"), F.size("service_ids").cast("long").alias("n_services")),
    "normalize_phone": lambda s, d: bookings(s, d).select("id", K.normalize_phone(F.col("phone")).alias("phone")),
    "validate_bookings": lambda s, d: K.validate_bookings(bookings(s, d), B.services(s, d)),
    "conditional_errors": lambda s, d: K.conditional_errors(bookings(s, d), B.services(s, d)),
    "service_modes": _svc(K.service_modes),
    "common_modes": _common,
    "mode_required": lambda s, d: K.requirements(_pairs(s, d), B.services(s, d)).select("request_id", "mode_required"),
    "payment_required": lambda s, d: K.requirements(_pairs(s, d), B.services(s, d)).select("request_id", "payment_required"),
    "confirmation_state": _state,
    "book_requests": lambda s, d: K.book_requests(bookings(s, d), B.services(s, d)),
    "request_services": _pairs,
    "expire_confirmations": lambda s, d: K.expire_confirmations(_confirmations(s, d).drop("payload")).select("id", "expires_at"),
}




def _times(column: str, percent: int) -> str:
    """Half-up rounding on integers of a hundredth of a unit."""
    return f"CAST(CAST((CAST({column} * 100 AS BIGINT) * {percent} + 50) // 100 AS BIGINT) AS DECIMAL(14,2)) / 100"


def _money(x: str) -> str:
    return f"CAST(({x}) AS DECIMAL(12,2))"


_ONLINE, _BANK = _money(_times("base_price", 90)), _money(_times("base_price", 110))
_PHONE = "regexp_replace(phone, '[^0-9+]', '', 'g')"
SQL = {
    "online_total": sql(f"SELECT id, {_ONLINE} AS online_total FROM requests", "requests"),
    "bank_total": sql(f"SELECT id, {_BANK} AS bank_total FROM requests", "requests"),
    "payable_total": sql(f"SELECT id, CASE WHEN payment_method = 'bank' THEN {_BANK} ELSE {_ONLINE} END AS payable_total FROM requests", "requests"),
    "is_free": sql("SELECT id, coalesce(base_price = 0, false) AS is_free FROM requests", "requests"),
    "to_cents": sql(f"SELECT id, CAST({_ONLINE} * 100 AS BIGINT) AS online_cents FROM requests", "requests"),
    "service_catalog": sql(f"SELECT id, name_en, price, {_money(_times('price', 90))} AS online_total, {_money(_times('price', 110))} AS bank_total FROM services", "services"),
    "localized_services": sql("SELECT id, coalesce(name_fr, name_en) AS name, coalesce(description_fr, description_en) AS description, CASE WHEN notes_fr IN ('', '0') THEN notes_en ELSE notes_fr END AS notes, coalesce(additional_notes_fr, additional_notes_en) AS additional_notes, CASE WHEN price_display_fr IS NULL OR price_display_fr IN ('', '0') THEN price_display_en ELSE price_display_fr END AS price_display FROM services", "services"),
    "price_label": sql("SELECT id, CASE WHEN price_display_en NOT IN ('', '0') THEN price_display_en WHEN price IS NULL OR price = 0 THEN 'Free' ELSE format('{:,}', (CAST(price * 100 AS BIGINT) + 50) // 100) || ' MAD' END AS price_label FROM services", "services"),
    "surcharge_lines": sql(f"SELECT id, CAST({_BANK} - base_price AS DECIMAL(12,2)) AS bank_fee, CAST(base_price - {_ONLINE} AS DECIMAL(12,2)) AS discount FROM requests", "requests"),
    "payment_route": sql(f"SELECT id, CASE WHEN coalesce(base_price = 0, false) OR payment_method = 'bank' THEN '' ELSE '{URL}' END AS url, CASE WHEN coalesce(base_price = 0, false) THEN '' ELSE '/payment/' || ticket_number END AS link FROM requests", "requests"),
    "booking_payload_scan": sql("SELECT id, full_name, email, payment_method, id % 100 AS first_service, CAST(2 AS BIGINT) AS n_services FROM requests", "requests"),
    "normalize_phone": sql(f"{_BOOK} SELECT id, {_PHONE} AS phone FROM bookings", "requests", "services"),
    "validate_bookings": sql(
        f"""{_BOOK}, bad AS (SELECT *, [
          CASE WHEN full_name IS NULL THEN 'full_name' END, CASE WHEN NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+$') THEN 'email' END,
          CASE WHEN NOT regexp_matches({_PHONE}, '^\\+?[1-9][0-9]{{8,14}}$') THEN 'phone' END,
          CASE WHEN len(service_ids) = 0 THEN 'service_ids' END, CASE WHEN len(list_distinct(service_ids)) < len(service_ids) THEN 'service_ids.distinct' END,
          CASE WHEN id IN (SELECT id FROM (SELECT id, unnest(service_ids) AS v FROM bookings) WHERE v NOT IN (SELECT id FROM services)) THEN 'service_ids.exists' END,
          CASE WHEN consultation_mode NOT IN ('office', 'whatsapp') THEN 'consultation_mode' END, CASE WHEN payment_method NOT IN ('google_pay', 'bank') THEN 'payment_method' END, CASE WHEN length(call_time) > 20 THEN 'call_time' END] AS codes FROM bookings)
        SELECT id, array_to_string(list_filter(codes, lambda c: c IS NOT NULL), ',') AS errors FROM bad""",
        "requests",
        "services",
    ),
    "conditional_errors": sql(
        f"""{_BOOK} SELECT b.id, concat_ws(',', CASE WHEN (office OR m.whatsapp) AND consultation_mode IS NULL THEN 'consultation_mode.required' END,
          CASE WHEN office AND NOT m.whatsapp AND consultation_mode <> 'office' OR m.whatsapp AND NOT office AND consultation_mode <> 'whatsapp' OR office AND m.whatsapp AND consultation_mode NOT IN ('office', 'whatsapp') THEN 'consultation_mode.allowed' END,
          CASE WHEN total > 0 AND payment_method IS NULL THEN 'payment_method.required' END) AS errors FROM bookings b LEFT JOIN modes m ON b.id = m.request_id""",
        "requests",
        "services",
    ),
    "service_modes": sql("SELECT id, CASE WHEN allows_office AND allows_whatsapp THEN 'office,whatsapp' WHEN allows_office THEN 'office' ELSE 'whatsapp' END AS modes FROM services", "services"),
    "common_modes": sql(f"{_BOOK} SELECT request_id, concat_ws(',', CASE WHEN office THEN 'office' END, CASE WHEN whatsapp THEN 'whatsapp' END) AS modes FROM modes", "requests", "services"),
    "mode_required": sql(f"{_BOOK} SELECT request_id, office OR whatsapp AS mode_required FROM modes", "requests", "services"),
    "payment_required": sql(f"{_BOOK} SELECT request_id, total > 0 AS payment_required FROM modes", "requests", "services"),
    "confirmation_state": sql(f"SELECT id, CASE WHEN id % 37 = 0 OR id % 5 = 0 THEN 'invalid' WHEN id % 11 = 0 OR created_at + INTERVAL 300 DAY < {_STAMP} THEN 'expired' ELSE 'ok' END AS state FROM requests", "requests"),
    "book_requests": sql(
        f"{_BOOK} SELECT b.id, CAST(total AS DECIMAL(10,2)) AS base_price, first AS service_id, CASE WHEN consultation_mode = 'office' AND m.office OR consultation_mode = 'whatsapp' AND m.whatsapp THEN consultation_mode END AS consultation_mode, CASE WHEN payment_method IN ('google_pay', 'bank') THEN payment_method ELSE 'google_pay' END AS payment_method, CASE WHEN total = 0 THEN 'pending' ELSE 'pending_payment' END AS status FROM bookings b JOIN modes m ON b.id = m.request_id",
        "requests",
        "services",
    ),
    "request_services": sql(f"{_BOOK} SELECT request_id, service_id FROM pairs", "requests", "services"),
    "expire_confirmations": sql("SELECT id, created_at + INTERVAL 24 HOUR AS expires_at FROM requests", "requests"),
}

#: Answers to the attempts of confirmation_events, and the tokens that expire before the stream's last watermark.
CONFIRMED = sql(
    """, c AS (SELECT id AS token, created_at, CASE WHEN id % 11 <> 0 THEN created_at + INTERVAL 24 HOUR END AS expires, id % 37 <> 0 AS there FROM requests),
a AS (SELECT token, token * 2 AS attempt_id, created_at + to_hours(token % 40) AS moment FROM c WHERE token % 3 <> 0 UNION ALL SELECT token, token * 2 + 1, created_at + to_hours(token % 40 + 1) FROM c WHERE token % 6 = 1),
j AS (SELECT a.*, expires, there, coalesce(there AND expires >= moment, false) AS valid FROM a JOIN c USING (token)),
w AS (SELECT token, min(attempt_id) AS winner FROM j WHERE valid GROUP BY token),
l AS (SELECT greatest((SELECT max(moment) FROM a), (SELECT max(created_at) FROM c WHERE there)) - INTERVAL 1 DAY AS mark)
SELECT token, attempt_id, CASE WHEN NOT there OR attempt_id > winner THEN 'invalid' WHEN expires IS NULL OR expires < moment THEN 'expired' ELSE 'ok' END AS outcome FROM j LEFT JOIN w USING (token)
UNION ALL SELECT token, NULL, 'expired' FROM c LEFT JOIN w USING (token), l WHERE there AND winner IS NULL AND (expires IS NULL OR expires + INTERVAL 1 MILLISECOND <= mark)""",
    "requests",
)
