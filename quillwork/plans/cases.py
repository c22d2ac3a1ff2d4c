"""Queries of advisor cases and admin analytics over the bound tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators import cases as C
from quillwork.operators.pages import deep_page
from quillwork.sources import bindings as B
from quillwork.sources.bindings import sql

ME, TERM, SERVICE = 3, " client 12", 42
NOW = "2001-07-20"
BARS = ["Rabat", "Casablanca", "BUILDING", "Tanger"]
_CASE = ("id", "ticket_number", "status", "case_status", "advisor_id")
_COLS = ", ".join(_CASE)


def _req(f):
    return lambda s, d: f(B.requests(s, d))


def _cases(f):
    return lambda s, d: f(B.requests(s, d)).select(*_CASE)


def _selected(s, d):
    return C.selected_services(B.requests(s, d), B.request_services(s, d))


def _on_selected(f):
    return lambda s, d: f(_selected(s, d))


_SEL = ", selected AS (SELECT * FROM request_services WHERE request_id IN (SELECT id FROM requests) UNION ALL SELECT id, service_id, NULL FROM requests WHERE service_id IS NOT NULL AND id NOT IN (SELECT request_id FROM request_services))"
_SEEN = "status IN ('paid', 'confirmed', 'pending')"
_PRICED = "(base_price IS NULL OR base_price > 0)"


def _pct(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN (200 * {part} + {whole}) // (2 * {whole}) ELSE 0 END AS BIGINT)"


_TERM = "(ticket_number ILIKE '%client 12%' OR full_name ILIKE '%client 12%' OR email ILIKE '%client 12%' OR phone ILIKE '%client 12%' OR coalesce(whatsapp ILIKE '%client 12%', false))"
_READY = f"(base_price = 0 AND status = 'pending' OR status = 'paid' OR status = 'confirmed' AND {_PRICED})"

QUERIES = {
    "visible_cases": _cases(C.visible_cases),
    "case_search": _cases(lambda r: C.case_search(r, TERM)),
    "case_filter_status": _cases(lambda r: C.case_filter_status(r, "open")),
    "case_filter_payment": _cases(lambda r: C.case_filter_payment(r, "confirmed")),
    "case_filter_advisor": _cases(lambda r: C.case_filter_advisor(r, "unclaimed")),
    "case_filter_service": lambda s, d: C.case_filter_service(B.requests(s, d), B.request_services(s, d), SERVICE).select(*_CASE),
    "case_page": _cases(lambda r: C.case_page(C.visible_cases(r), page=2)),
    "case_page_strip": _req(lambda r: C.case_page_strip(C.case_page(C.visible_cases(r), page=3), ME)),
    "advisor_dashboard": _req(lambda r: C.advisor_dashboard(r, ME)),
    "advisor_dashboard_all": _req(C.advisor_dashboard_all),
    "selected_services": _on_selected(lambda x: x),
    "completed_services": _on_selected(C.completed_services),
    "missing_services": _on_selected(lambda x: C.missing_services(x).select("request_id", "service_id")),
    "task_progress": lambda s, d: C.task_progress(B.requests(s, d), _selected(s, d)),
    "fully_completed": _on_selected(C.fully_completed),
    "dashboard_percentages": lambda s, d: C.dashboard_percentages(B.requests(s, d), _selected(s, d)),
    "services_summary": lambda s, d: C.services_summary(_selected(s, d), B.services(s, d)),
    "recent_cases": _cases(C.recent_cases),
    "stale_cases": _cases(lambda r: C.stale_cases(r, F.lit(NOW).cast("timestamp_ntz"))),
    "case_notes_timeline": lambda s, d: C.case_notes_timeline(B.notes(s, d), B.users(s, d), 17),
    "claim_state": _req(lambda r: C.claim_state(r, ME)),
    "notes_total": lambda s, d: C.notes_total(B.notes(s, d)),
    "advisor_directory": lambda s, d: C.advisor_directory(B.users(s, d), page=2),
    "service_directory": lambda s, d: C.service_directory(B.services(s, d)),
    "deep_case_page": lambda s, d: deep_page(B.requests(s, d), ["case_status", "created_at", "id"], 300, 4).select("id", "case_status", "created_at"),
    "deep_recent_page": lambda s, d: deep_page(B.requests(s, d), ["created_at desc", "id"], 200, 5).select("id", "created_at"),
    "notification_fanout": lambda s, d: C.notification_fanout(B.requests(s, d), B.users(s, d)),
    "payment_split": _req(C.payment_split),
    "paid_share": _req(C.paid_share),
    "admin_kpis": lambda s, d: C.admin_kpis(B.requests(s, d), B.users(s, d)),
    "recent_requests": _cases(C.recent_requests),
    "admin_requests": lambda s, d: C.admin_requests(B.requests(s, d), B.request_services(s, d), B.services(s, d)),
    "users_latest": lambda s, d: C.users_latest(B.users(s, d)),
    "bar_list": lambda s, d: C.bar_list(B.users(s, d), BARS),
    "role_labels": lambda s, d: C.role_labels(B.users(s, d)),
    "status_labels": _req(C.status_labels),
    "request_timeline": _req(C.request_timeline),
}

SQL = {
    "visible_cases": sql(f"SELECT {_COLS} FROM requests WHERE {_SEEN}", "requests"),
    "case_search": sql(f"SELECT {_COLS} FROM requests WHERE {_TERM}", "requests"),
    "case_filter_status": sql(f"SELECT {_COLS} FROM requests WHERE case_status = 'open'", "requests"),
    "case_filter_payment": sql(f"SELECT {_COLS} FROM requests WHERE status = 'confirmed' AND {_PRICED}", "requests"),
    "case_filter_advisor": sql(f"SELECT {_COLS} FROM requests WHERE advisor_id IS NULL", "requests"),
    "case_filter_service": sql(f"SELECT {_COLS} FROM requests r WHERE EXISTS (SELECT 1 FROM request_services p WHERE p.request_id = r.id AND p.service_id = {SERVICE})", "requests", "request_services"),
    "case_page": sql(f"SELECT {_COLS} FROM requests WHERE {_SEEN} ORDER BY case_status, created_at, id LIMIT 4 OFFSET 4", "requests"),
    "case_page_strip": sql(f", p AS (SELECT * FROM requests WHERE {_SEEN} ORDER BY case_status, created_at, id LIMIT 4 OFFSET 8) SELECT count_if(case_status = 'open') AS open, count_if(case_status = 'closed') AS closed, count_if(advisor_id IS NULL) AS unclaimed, count_if(advisor_id = {ME}) AS mine FROM p", "requests"),
    "advisor_dashboard": sql(f"SELECT count(*) AS total, count_if(case_status = 'open') AS open, count_if(case_status = 'closed') AS closed, count_if(advisor_id IS NULL) AS unclaimed, count_if(advisor_id = {ME}) AS mine, count_if(advisor_id = {ME} AND case_status = 'open') AS my_open FROM requests WHERE {_SEEN}", "requests"),
    "advisor_dashboard_all": sql(f"SELECT advisor_id, count(*) AS mine, count_if(case_status = 'open') AS my_open FROM requests WHERE {_SEEN} AND advisor_id IS NOT NULL GROUP BY advisor_id", "requests"),
    "selected_services": sql(f"{_SEL} SELECT * FROM selected", "requests", "request_services"),
    "completed_services": sql(f"{_SEL} SELECT * FROM selected WHERE completed_at IS NOT NULL", "requests", "request_services"),
    "missing_services": sql(f"{_SEL} SELECT request_id, service_id FROM selected WHERE completed_at IS NULL", "requests", "request_services"),
    "task_progress": sql(f"{_SEL}, t AS (SELECT r.id, count(s.request_id) AS total, count(s.completed_at) AS done FROM requests r LEFT JOIN selected s ON s.request_id = r.id GROUP BY r.id) SELECT id, total, done, {_pct('done', 'total')} AS percent FROM t", "requests", "request_services"),
    "fully_completed": sql(f"{_SEL} SELECT request_id FROM selected GROUP BY request_id HAVING bool_and(completed_at IS NOT NULL)", "requests", "request_services"),
    "dashboard_percentages": sql(
        f"{_SEL}, v AS (SELECT * FROM requests WHERE {_SEEN}), a AS (SELECT count(*) AS n, count_if(case_status = 'open') AS o, count_if(case_status = 'closed') AS c FROM v), b AS (SELECT count(*) AS tasks, count(completed_at) AS done FROM selected WHERE request_id IN (SELECT id FROM v)) SELECT {_pct('o', 'n')} AS open_percent, {_pct('c', 'n')} AS closed_percent, {_pct('done', 'tasks')} AS tasks_percent FROM a, b",
        "requests",
        "request_services",
    ),
    "services_summary": sql(f"{_SEL} SELECT request_id, string_agg(name_en, ', ' ORDER BY service_id) AS names FROM selected JOIN services ON service_id = services.id GROUP BY request_id", "requests", "request_services", "services"),
    "recent_cases": sql(f"SELECT {_COLS} FROM requests WHERE {_SEEN} ORDER BY created_at DESC, id LIMIT 5", "requests"),
    "stale_cases": sql(f"SELECT {_COLS} FROM requests WHERE last_touched_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY", "requests"),
    "case_notes_timeline": sql("SELECT n.id, note, name AS author, created_at FROM notes n LEFT JOIN users u ON n.user_id = u.id WHERE request_id = 17", "notes", "users"),
    "claim_state": sql(f"SELECT id, CASE WHEN advisor_id IS NULL THEN 'unclaimed' WHEN advisor_id = {ME} THEN 'mine' ELSE 'other' END AS claim FROM requests", "requests"),
    "notes_total": sql("SELECT count(*) AS notes FROM notes", "notes"),
    "advisor_directory": sql("SELECT id, name, email FROM users WHERE role = 'advisor' ORDER BY name, id LIMIT 5 OFFSET 5", "users"),
    "service_directory": sql("SELECT id, name_en FROM services", "services"),
    "deep_case_page": sql("SELECT id, case_status, created_at FROM requests ORDER BY case_status, created_at, id LIMIT 4 OFFSET 1196", "requests"),
    "deep_recent_page": sql("SELECT id, created_at FROM requests ORDER BY created_at DESC, id LIMIT 5 OFFSET 995", "requests"),
    "notification_fanout": sql(f"SELECT ticket_number, u.email FROM requests r, users u WHERE role = 'advisor' AND {_READY}", "requests", "users"),
    "payment_split": sql(f"SELECT count_if(status = 'paid' AND {_PRICED}) AS google_pay_paid, count_if(status = 'confirmed' AND {_PRICED}) AS bank_confirmed, count_if(base_price = 0) AS free FROM requests", "requests"),
    "paid_share": sql(f", x AS (SELECT count_if(status IN ('paid', 'confirmed') AND {_PRICED}) AS paid, count_if(base_price = 0) AS free FROM requests) SELECT paid, free, {_pct('paid', '(paid + free)')} AS paid_percent FROM x", "requests"),
    "admin_kpis": sql("SELECT count_if(status IN ('pending_payment', 'pending')) AS pending, count_if(status = 'confirmed') AS confirmed, (SELECT count(*) FROM users) AS users FROM requests", "requests", "users"),
    "recent_requests": sql(f"SELECT {_COLS} FROM requests ORDER BY created_at DESC, id LIMIT 5", "requests"),
    "admin_requests": sql(", p AS (SELECT * FROM requests ORDER BY created_at DESC, id LIMIT 5) SELECT p.id, ticket_number, status, coalesce((SELECT string_agg(name_en, ', ' ORDER BY s.id) FROM request_services x JOIN services s ON x.service_id = s.id WHERE x.request_id = p.id), '') AS services FROM p", "requests", "request_services", "services"),
    "users_latest": sql("SELECT id, name, role FROM users ORDER BY id DESC", "users"),
    "bar_list": sql(", f AS (SELECT * FROM (VALUES ('Rabat', 0), ('Casablanca', 1), ('BUILDING', 2), ('Tanger', 3)) t(bar, place)) SELECT bar, CAST(place AS BIGINT) AS place FROM f UNION ALL SELECT DISTINCT trim(bar), CAST(4 AS BIGINT) FROM users WHERE trim(bar) NOT IN ('', '__custom_bar__') AND trim(bar) NOT IN (SELECT bar FROM f)", "users"),
    "role_labels": sql("SELECT id, CASE role WHEN 'admin' THEN 'Admin' WHEN 'advisor' THEN 'Advisor' ELSE 'User' END AS label FROM users", "users"),
    "status_labels": sql("SELECT id, CASE WHEN base_price = 0 THEN 'Free' WHEN status = 'pending_payment' THEN 'Pending Payment' ELSE upper(status[1]) || status[2:] END AS label FROM requests", "requests"),
    "request_timeline": sql("SELECT id, 'Submitted' AS step, created_at AS at FROM requests UNION ALL SELECT id, 'Paid', paid_at FROM requests WHERE paid_at IS NOT NULL UNION ALL SELECT id, 'Confirmed', confirmed_at FROM requests WHERE confirmed_at IS NOT NULL", "requests"),
}
