"""Queries of payments, maintenance and the declared jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.operators import declared as D
from quillwork.operators import maintain as M
from quillwork.operators import payments as P
from quillwork.operators.corpus import CATEGORIES
from quillwork.operators.dictionary import bundled, entries
from quillwork.plans.booking import CONFIRMED
from quillwork.plans.cases import _READY
from quillwork.sources import bindings as B
from quillwork.sources.bindings import sql
from quillwork.streaming import jobs

GONE = "s_suppkey"


def _req(f):
    return lambda s, d: f(B.requests(s, d))


def _pay(f):
    return lambda s, d: f(B.payment_events(s, d), B.requests(s, d))


def intents(s, d):
    """Payment events as intents that are verified for a ticket; some match their request."""
    e, r = B.payment_events(s, d), B.requests(s, d)
    exact = r.select(F.col("id").alias("request_id"), P.to_cents(P.online_total(F.col("base_price"))).alias("due"))
    rows = e.join(exact, "request_id", "left")
    k = F.col("event_id")
    return rows.select(
        "event_id",
        F.when(k % 41 == 0, "intent").otherwise(F.concat("intent_id", F.lit("x"), k.cast("string"))).alias("intent_id"),
        "request_id",
        F.lpad(F.col("request_id").cast("string"), 10, "0").alias("ticket_number"),
        F.when(k % 7 == 0, F.lpad((F.col("request_id") + 1).cast("string"), 10, "0")).when(k % 11 == 0, "none").otherwise(F.lpad(F.col("request_id").cast("string"), 10, "0")).alias("asked_ticket"),
        F.when(k % 3 != 0, F.col("due")).otherwise(F.col("amount_cents")).alias("amount_cents"),
        "currency",
        F.coalesce(P.state_of(F.col("type")), F.lit("processing")).alias("status"),
    )


def _methods(s, d):
    n = B.read(s, d, "nation").where("n_nationkey < 5")
    return n.select(F.concat(F.lit("pm_"), F.col("n_nationkey").cast("string")).alias("method_id"), F.when(F.col("n_nationkey") % 2 == 0, "apple_pay").alias("wallet"), F.when(F.col("n_nationkey") != 3, "card").alias("kind"))


def transactions(s, d):
    e = B.payment_events(s, d)
    states = F.array(*[F.lit(x) for x in ("requires_payment_method", "requires_confirmation", "requires_action", "processing", "succeeded")])
    return e.select(F.col("event_id").alias("id"), "request_id", F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("status"))


def actions(s, d):
    """An action log of cases from the events."""
    e = B.read(s, d, "events")
    kinds = F.create_map(*[F.lit(x) for x in ("click", "toggle", "view", "note", "signup", "claim", "purchase", "close", "error", "reopen")])
    return e.select((F.col("event_id") % 700).alias("case_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kinds[F.col("event_type")].alias("action"), (F.col("user_id") % 3).alias("service_id"), F.col("user_id"))


def _snapshot(s, d):
    v = B.services(s, d)
    target = v.where("id % 5 <> 0").select("id", "name_en", "price")
    source = v.where("id % 3 <> 0").select("id", F.upper("name_en").alias("name_en"))
    return M.snapshot_sync(target, source, "id")


def _gone(s, d):
    return B.documents(s, d).where("id % 6 = 0").select("id")


def category_terms(s, d):
    """The bundled dictionary, and as terms of the corpus itself the first two words of every document, with a category and weight by id."""
    docs = B.read(s, d, "documents")
    first = F.regexp_extract(F.lower("text"), r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+)?)", 1)
    code = F.element_at(F.array(*[F.lit(c) for c in sorted(CATEGORIES)]), (F.col("doc_id") % len(CATEGORIES) + 1).cast("int"))
    own = docs.select(F.regexp_replace(first, r"[^\p{L}\p{N}]+", " ").alias("phrase"), code.alias("category"), (F.col("doc_id") % 5 + 1).cast("int").alias("weight"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("language"))
    own = own.where("phrase <> ''").groupBy("phrase", "category", "language").agg(F.max("weight").alias("weight"))
    return bundled(s).unionByName(own)


def stored_transactions(s, d):
    """Payment events as stored transactions, some of which break a rule."""
    k = F.col("event_id")
    return B.payment_events(s, d).select(
        "request_id", F.concat("intent_id", F.lit("_"), (k % 4000).cast("string")).alias("intent_id"), "method",
        F.when(k % 53 != 0, F.when(k % 59 == 0, "euro").otherwise(F.col("currency"))).alias("currency"), F.when(k % 61 == 0, "MAR").otherwise("MA").alias("country"),
        (F.col("amount_cents") - 1000).alias("amount_cents"), F.when(k % 67 != 0, F.col("amount_cents") / 100).alias("amount"), "type",
        F.substring("type", 1, 32).alias("status"), F.get("method_types", F.lit(0)).alias("method_type"),
        F.repeat("failure_code", (k % 10).cast("int")).alias("failure_code"), F.when(k % 71 == 0, "{").when(k % 3 == 0, F.concat(F.lit('{"n": '), k.cast("string"), F.lit("}"))).alias("payload"),
    )


def stored_confirmations(s, d):
    """Confirmations as stored, some of which break a rule."""
    r, o = B.requests(s, d), F.col("id")
    token = F.concat(F.lit("t"), (o % 997).cast("string"), F.when(o % 29 == 0, F.repeat(F.lit("x"), 64)).otherwise(""))
    return r.select(token.alias("token"), F.when(o % 31 != 0, F.col("email")).alias("email"), F.when(o % 37 == 0, "[1").when(o % 41 != 0, '{"a": 1}').alias("payload"), F.when(o % 43 != 0, F.col("created_at")).alias("expires_at"))


QUERIES = {
    "service_constraints": lambda s, d: M.service_constraints(B.services(s, d)),
    "payment_constraints": lambda s, d: M.payment_constraints(stored_transactions(s, d), stored_confirmations(s, d), B.requests(s, d)),
    "categorize_terms": lambda s, d: D.categorize_by(B.read(s, d, "documents"), category_terms(s, d), most=2),
    "intent_eligibility": _req(P.intent_eligibility),
    "stale_intents": lambda s, d: P.stale_intents(transactions(s, d)),
    "reconcile_payments": lambda s, d: P.reconcile_payments(intents(s, d), B.requests(s, d)),
    "payment_method_type": lambda s, d: P.payment_method_type(B.payment_events(s, d), _methods(s, d)),
    "transactions_latest": _pay(P.transactions_latest),
    "paid_requests": _pay(P.paid_requests),
    "backfill_free_status": _req(lambda r: M.backfill_free_status(M.backfill_free_status(r, back=True).withColumn("status", F.when(F.col("id") % 2 == 0, F.col("status")).otherwise("pending_payment"))).select("id", "status")),
    "snapshot_sync": _snapshot,
    "cascade_delete": lambda s, d: M.cascade_delete(B.articles(s, d).select("id", "document_id"), "document_id", _gone(s, d)),
    "null_on_delete": lambda s, d: M.null_on_delete(B.requests(s, d).select("id", "advisor_id"), "advisor_id", B.users(s, d).where("role = 'admin'")),
    "constraint_report": lambda s, d: M.constraint_report(B.requests(s, d), B.request_services(s, d), B.services(s, d), B.users(s, d).where("role = 'advisor'")),
    "corpus_constraints": lambda s, d: M.corpus_constraints(B.documents(s, d), B.articles(s, d)),
    "people_constraints": lambda s, d: M.people_constraints(B.users(s, d), B.notes(s, d), B.requests(s, d), transactions(s, d).withColumn("intent_id", F.concat(F.lit("pi_"), (F.col("id") % 900).cast("string")))),
    "case_state_fold": lambda s, d: M.case_state_fold(actions(s, d)),
    "admin_action_eligibility": _req(M.admin_action_eligibility),
    "semantic_topk": lambda s, d: D.semantic_topk(B.read(s, d, "embeddings"), min_score=0.3).select("query_id", "rank", "vec_id", F.round("score", 3).alias("score")),
    "extract_pages": lambda s, d: D.extract_pages(B.read(s, d, "pages")),
    "chunk_documents": lambda s, d: D.chunk_documents(B.read(s, d, "documents")),
    "parse_articles": lambda s, d: D.parse_references(B.articles(s, d).select("id", F.concat_ws("\n", "article_number", "text").alias("text")), "id"),
    "categorize": lambda s, d: D.categorize(B.read(s, d, "documents")),
    "webhook_source": jobs.webhook_events_batch,
    "webhook_fold": jobs.webhook_fold_query,
    "sync_articles": jobs.sync_articles_query,
    "sync_report": jobs.sync_report_query,
    "webhook_stream": jobs.webhook_stream_query,
    "webhook_rejects": jobs.webhook_rejects_query,
    "case_state_stream": jobs.case_state_stream_query,
    "case_services": lambda s, d: M.case_services(actions(s, d)),
    "case_services_stream": jobs.case_services_stream_query,
    "confirmation_stream": jobs.confirmation_stream_query,
    "notification_transitions": jobs.notification_transitions_query,
    "notification_messages": jobs.notification_messages_query,
}

_DUE = "CAST((CAST(base_price * 100 AS BIGINT) * 90 + 50) // 100 AS BIGINT)"
_KIND = "CASE type WHEN 'payment_intent.succeeded' THEN 'succeeded' WHEN 'payment_intent.payment_failed' THEN 'failed' WHEN 'payment_intent.canceled' THEN 'canceled' END"
_FREE = "coalesce(base_price = 0, false)"
_LATEST = f", e AS (SELECT *, {_KIND} AS status, request_id IN (SELECT id FROM requests) AS known FROM payment_events), f AS (SELECT intent_id, min((ts, event_id)) AS first FROM e WHERE status = 'succeeded' AND known GROUP BY intent_id), t AS (SELECT intent_id, arg_max(status, (ts, event_id)) AS status, bool_or(status = 'succeeded') AS ever_succeeded, arg_max(failure_code, (ts, event_id)) FILTER (WHERE status = 'failed') AS failure_code, arg_max(failure_message, (ts, event_id)) FILTER (WHERE status = 'failed') AS failure_message FROM e JOIN f USING (intent_id) WHERE status IS NOT NULL AND (ts, event_id) >= first GROUP BY intent_id)"
_ACTIONS = "WITH a AS (SELECT event_id % 700 AS case_id, event_id AS seq, ts AS moment, CASE event_type WHEN 'click' THEN 'toggle' WHEN 'view' THEN 'note' WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'close' ELSE 'reopen' END AS action, user_id % 3 AS service_id, user_id FROM events)"
_FOLD = f"""{_ACTIONS}, c AS (SELECT case_id, arg_min(user_id, seq) FILTER (WHERE action = 'claim') AS advisor_id, arg_min(moment, seq) FILTER (WHERE action = 'claim') AS first_contact_at, arg_max(action, seq) FILTER (WHERE action IN ('close', 'reopen')) AS turn, arg_max(moment, seq) FILTER (WHERE action IN ('close', 'reopen')) AS turned, max(moment) AS last_touched_at FROM a GROUP BY case_id),
d AS (SELECT case_id, count(*) AS completed FROM (SELECT case_id, service_id FROM a WHERE action = 'toggle' GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY case_id)
SELECT case_id, advisor_id, first_contact_at, CASE WHEN turn = 'close' THEN 'closed' ELSE 'open' END AS case_status, CASE WHEN turn = 'close' THEN turned END AS closed_at, last_touched_at, coalesce(completed, 0) AS completed FROM c LEFT JOIN d USING (case_id)"""


def _bad(rule: str, condition: str) -> str:
    return f"SELECT '{rule}' AS rule, count_if({condition}) AS violations FROM requests"


_REPORT = " UNION ALL ".join([
    _bad("requests.full_name null", "full_name IS NULL"),
    _bad("requests.ticket_number length", "length(ticket_number) > 10"),
    _bad("requests.full_name length", "length(full_name) > 255"),
    _bad("requests.email null", "email IS NULL"),
    _bad("requests.email length", "length(email) > 255"),
    _bad("requests.phone null", "phone IS NULL"),
    _bad("requests.phone length", "length(phone) > 40"),
    _bad("requests.status length", "length(status) > 20"),
    _bad("requests.base_price negative", "base_price < 0"),
    _bad("requests.status domain", "status NOT IN ('pending_payment', 'pending', 'paid', 'confirmed', 'rejected')"),
    _bad("requests.case_status domain", "case_status NOT IN ('open', 'closed')"),
    _bad("requests.payment_method domain", "payment_method NOT IN ('google_pay', 'bank')"),
    "SELECT 'requests.id unique', count(*) - count(DISTINCT id) FROM requests",
    "SELECT 'requests.ticket_number unique', count(*) - count(DISTINCT ticket_number) FROM requests",
    "SELECT 'request_services unique', count(*) - count(DISTINCT (request_id, service_id)) FROM request_services",
    "SELECT 'request_services.request_id', count_if(request_id NOT IN (SELECT id FROM requests)) FROM request_services",
    "SELECT 'request_services.service_id', count_if(service_id NOT IN (SELECT id FROM services)) FROM request_services",
    "SELECT 'requests.advisor_id', count_if(advisor_id IS NOT NULL AND advisor_id NOT IN (SELECT id FROM users WHERE role = 'advisor')) FROM requests",
])


def _lengths(name: str, relation: str, columns: dict[str, int | None]) -> list[str]:
    """A query a rule, for columns that may be null where a '?' stands behind them."""
    rules = []
    for column, most in columns.items():
        c, sql_name = column.rstrip("?"), {"group?": "grp"}.get(column, column.rstrip("?"))
        if c == column:
            rules.append(f"SELECT '{name}.{c} null' AS rule, count_if({sql_name} IS NULL) AS violations FROM {relation}")
        if most is not None:
            rules.append(f"SELECT '{name}.{c} length' AS rule, count_if(length({sql_name}) > {most}) AS violations FROM {relation}")
    return rules


_CORPUS_RULES = " UNION ALL ".join([
    *_lengths("documents", "docs", {"title": 500, "language": 10, "type": 50, "source_file": 500, "group?": 100}),
    *_lengths("articles", "arts", {"document_id": None, "article_number": 50, "text": None, "sort_key": None, "path?": 500, "slug?": 500, "chapter?": 500}),
    "SELECT 'documents.id unique', count(*) - count(DISTINCT id) FROM docs",
    "SELECT 'articles.id unique', count(*) - count(DISTINCT id) FROM arts",
    "SELECT 'articles.document_id', count_if(document_id NOT IN (SELECT id FROM docs)) FROM arts",
])
_PEOPLE_RULES = ", t AS (SELECT request_id, CASE event_id % 5 WHEN 0 THEN 'requires_payment_method' WHEN 1 THEN 'requires_confirmation' WHEN 2 THEN 'requires_action' WHEN 3 THEN 'processing' ELSE 'succeeded' END AS status, 'pi_' || (event_id % 900) AS intent_id FROM payment_events) " + " UNION ALL ".join([
    *_lengths("users", "users", {"name": 255, "email": 255, "role": 20}),
    *_lengths("notes", "notes", {"request_id": None, "note": None}),
    *_lengths("transactions", "t", {"request_id": None, "status": 30, "intent_id": 64}),
    "SELECT 'users.email unique', count(*) - count(DISTINCT email) FROM users",
    "SELECT 'transactions.intent_id unique', count(*) - count(DISTINCT intent_id) FROM t",
    "SELECT 'notes.request_id', count_if(request_id NOT IN (SELECT id FROM requests)) FROM notes",
    "SELECT 'notes.user_id', count_if(user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)) FROM notes",
    "SELECT 'transactions.request_id', count_if(request_id NOT IN (SELECT id FROM requests)) FROM t",
])
_SERVICE_RULES = " UNION ALL ".join([
    *_lengths("services", "services", {"name_en": 255, "name_fr": 255, "name_ar": 255, "description_en?": 1000, "description_fr?": 1000, "price_display_en?": 255, "price_display_fr?": 255, "notes_en?": 255, "notes_fr?": 255, "additional_notes_en?": 255, "additional_notes_fr?": 255, "price": None, "allows_office": None, "allows_whatsapp": None}),
    "SELECT 'services.price negative', count_if(price < 0) FROM services",
    "SELECT 'services.id unique', count(*) - count(DISTINCT id) FROM services",
])
_PAYMENT_RULES = """, t AS (SELECT request_id, intent_id || '_' || (event_id % 4000) AS intent_id, method, CASE WHEN event_id % 53 <> 0 THEN CASE WHEN event_id % 59 = 0 THEN 'euro' ELSE currency END END AS currency, CASE WHEN event_id % 61 = 0 THEN 'MAR' ELSE 'MA' END AS country, amount_cents - 1000 AS amount_cents, CASE WHEN event_id % 67 <> 0 THEN amount_cents / 100 END AS amount, substr(type, 1, 32) AS status, method_types[1] AS method_type, repeat(failure_code, event_id % 10) AS failure_code, CASE WHEN event_id % 71 = 0 THEN '{' WHEN event_id % 3 = 0 THEN '{"n": ' || event_id || '}' END AS payload FROM payment_events),
c AS (SELECT 't' || (id % 997) || CASE WHEN id % 29 = 0 THEN repeat('x', 64) ELSE '' END AS token, CASE WHEN id % 31 <> 0 THEN email END AS email, CASE WHEN id % 37 = 0 THEN '[1' WHEN id % 41 <> 0 THEN '{"a": 1}' END AS payload, CASE WHEN id % 43 <> 0 THEN created_at END AS expires_at FROM requests) """ + " UNION ALL ".join([
    *_lengths("transactions", "t", {"request_id": None, "intent_id": 64, "method?": 64, "currency": 3, "country": 2, "amount_cents": None, "amount": None, "status": 30, "method_type?": 30, "failure_code?": 100}),
    "SELECT 'transactions.amount_cents negative', count_if(amount_cents < 0) FROM t",
    "SELECT 'transactions.payload json', count_if(payload IS NOT NULL AND NOT json_valid(payload)) FROM t",
    *_lengths("confirmations", "c", {"token": 64, "email": 255, "payload": None, "expires_at": None}),
    "SELECT 'confirmations.payload json', count_if(payload IS NOT NULL AND NOT json_valid(payload)) FROM c",
    "SELECT 'transactions.intent_id unique', count(*) - count(DISTINCT intent_id) FROM t",
    "SELECT 'confirmations.token unique', count(*) - count(DISTINCT token) FROM c",
    "SELECT 'transactions.request_id', count_if(request_id NOT IN (SELECT id FROM requests)) FROM t",
])
_INTENTS = f""", i AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'intent' ELSE intent_id || 'x' || event_id END AS intent_id, request_id, lpad(CAST(request_id AS VARCHAR), 10, '0') AS ticket_number,
  CASE WHEN event_id % 7 = 0 THEN lpad(CAST(request_id + 1 AS VARCHAR), 10, '0') WHEN event_id % 11 = 0 THEN 'none' ELSE lpad(CAST(request_id AS VARCHAR), 10, '0') END AS asked,
  CASE WHEN event_id % 3 <> 0 THEN {_DUE} ELSE amount_cents END AS amount, currency, coalesce({_KIND}, 'processing') AS status FROM payment_events e LEFT JOIN (SELECT id, base_price FROM requests) r ON e.request_id = r.id)"""

_CODES = "[" + ", ".join(f"'{c}'" for c in sorted(CATEGORIES)) + "]"
_TERMS = ", ".join(f"('{p}', '{c}', {w}, '{lang}')" for p, c, w, lang in entries())
_CATEGORIZED = f"""WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT * FROM (VALUES {_TERMS}) t(phrase, category, weight, language) UNION ALL
  SELECT phrase, category, max(weight), language FROM (SELECT array_to_string(ws[1:2], ' ') AS phrase, {_CODES}[doc_id % {len(CATEGORIES)} + 1] AS category, doc_id % 5 + 1 AS weight, CASE WHEN doc_id % 2 = 0 THEN lang END AS language FROM w) WHERE phrase <> '' GROUP BY phrase, category, language),
u AS (SELECT doc_id, lang, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
r AS (SELECT doc_id, lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, lang, a AS phrase FROM r UNION ALL SELECT doc_id, lang, a || ' ' || b FROM r UNION ALL SELECT doc_id, lang, a || ' ' || b || ' ' || c FROM r UNION ALL SELECT doc_id, lang, a || ' ' || b || ' ' || c || ' ' || d FROM r UNION ALL SELECT doc_id, lang, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e FROM r),
c AS (SELECT doc_id, category, CAST(sum(weight) AS BIGINT) AS score FROM p JOIN k USING (phrase) WHERE language IS NULL OR language = lang GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS INTEGER) AS rank, category, score FROM c QUALIFY rank <= 2"""

SQL = {
    "service_constraints": sql(_SERVICE_RULES, "services"),
    "payment_constraints": sql(_PAYMENT_RULES, "payment_events", "requests"),
    "categorize_terms": _CATEGORIZED,
    "intent_eligibility": sql(f", c AS (SELECT id, {_DUE} AS cents, CASE WHEN {_FREE} THEN 422 WHEN status IN ('paid', 'confirmed') THEN 409 WHEN base_price IS NULL THEN 422 WHEN {_DUE} < 100 THEN 422 ELSE 200 END AS code FROM requests) SELECT id, code, CASE WHEN code = 200 THEN cents END AS cents, CASE WHEN code = 200 THEN 'mad' END AS currency FROM c", "requests"),
    "stale_intents": sql(", t AS (SELECT event_id AS id, request_id, CASE event_id % 5 WHEN 0 THEN 'requires_payment_method' WHEN 1 THEN 'requires_confirmation' WHEN 2 THEN 'requires_action' WHEN 3 THEN 'processing' ELSE 'succeeded' END AS status FROM payment_events) SELECT * FROM t WHERE status LIKE 'requires%'", "payment_events"),
    "reconcile_payments": sql(f"{_INTENTS} SELECT event_id, regexp_matches(intent_id, '^pi_[A-Za-z0-9]+$') AS well_formed, CASE WHEN r.id IS NULL THEN 404 WHEN NOT coalesce(amount IS NOT DISTINCT FROM {_DUE} AND lower(currency) = 'mad' AND request_id = r.id AND i.ticket_number = asked, false) THEN 422 WHEN i.status <> 'succeeded' THEN 409 ELSE 200 END AS outcome FROM i LEFT JOIN requests r ON i.asked = r.ticket_number", "payment_events", "requests"),
    "payment_method_type": sql(", m AS (SELECT 'pm_' || n_nationkey AS method_id, CASE WHEN n_nationkey % 2 = 0 THEN 'apple_pay' END AS wallet, CASE WHEN n_nationkey <> 3 THEN 'card' END AS kind FROM nation WHERE n_nationkey < 5) SELECT event_id, CASE WHEN method IS NULL THEN coalesce(method_types[1], 'card') ELSE coalesce(wallet, kind, CASE WHEN method_id IS NULL THEN method_types[1] END, 'card') END AS method_type FROM payment_events LEFT JOIN m ON method = method_id", "payment_events"),
    "transactions_latest": sql(f"{_LATEST} SELECT * FROM t", "payment_events", "requests"),
    "paid_requests": sql(", w AS (SELECT request_id, min(ts) AS won FROM payment_events WHERE type = 'payment_intent.succeeded' GROUP BY request_id) SELECT id, CASE WHEN won IS NOT NULL THEN 'paid' ELSE status END AS status, CASE WHEN won IS NOT NULL AND status <> 'paid' THEN won ELSE paid_at END AS paid_at, CASE WHEN won IS NULL OR status = 'paid' THEN receipt_path END AS receipt_path FROM requests LEFT JOIN w ON id = request_id", "payment_events", "requests"),
    "backfill_free_status": sql("SELECT id, CASE WHEN base_price = 0 AND (id % 2 = 1 OR status IN ('pending', 'pending_payment')) THEN 'pending' WHEN id % 2 = 1 THEN 'pending_payment' ELSE status END AS status FROM requests", "requests"),
    "snapshot_sync": sql(", t AS (SELECT id, name_en, price FROM services WHERE id % 5 <> 0), s AS (SELECT id, upper(name_en) AS name_en FROM services WHERE id % 3 <> 0) SELECT coalesce(t.id, s.id) AS id, s.name_en, CASE WHEN s.id IS NOT NULL THEN t.price END AS price, CASE WHEN s.id IS NULL THEN 'delete' WHEN t.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM t FULL JOIN s ON t.id = s.id", "services"),
    "cascade_delete": sql("SELECT id, document_id FROM arts WHERE document_id % 6 <> 0", "arts"),
    "null_on_delete": sql("SELECT id, CASE WHEN advisor_id NOT IN (SELECT id FROM users WHERE role = 'admin') THEN advisor_id END AS advisor_id FROM requests", "requests", "users"),
    "constraint_report": sql(_REPORT, "requests", "request_services", "services", "users"),
    "corpus_constraints": sql(_CORPUS_RULES, "docs", "arts"),
    "people_constraints": sql(_PEOPLE_RULES, "users", "notes", "requests", "payment_events"),
    "case_state_fold": _FOLD,
    "admin_action_eligibility": sql(f"SELECT id, status <> 'paid' AND (receipt_path IS NOT NULL OR {_FREE}) AS can_confirm, status <> 'paid' AND receipt_path IS NOT NULL AS can_reject, status <> 'paid' AS can_resend FROM requests", "requests"),
    "semantic_topk": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(c.x, q.x), 6) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p WHERE score >= 0.3) SELECT query_id, rank, vec_id, round(score, 3) AS score FROM r WHERE rank <= 12",
    "chunk_documents": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l) SELECT doc_id, CAST(start // 1000 AS BIGINT) AS chunk, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY ALL",
    "parse_articles": sql(", x AS (SELECT id, concat_ws(chr(10), article_number, text) AS text FROM arts) SELECT id, 'article' AS kind, unnest(regexp_extract_all(text, '(?i)\\b(?:article|artikel|artículo|art\\.)\\s+(\\d+)', 1)) AS value, CAST(generate_subscripts(regexp_extract_all(text, '(?i)\\b(?:article|artikel|artículo|art\\.)\\s+(\\d+)', 1), 1) AS INTEGER) AS n FROM x UNION ALL SELECT id, 'law', unnest(regexp_extract_all(text, '(?i)\\b(?:law|loi|gesetz|ley)\\s+(?:no\\.?\\s*)?(\\d+[-/.]\\d+)', 1)), 1 FROM x UNION ALL SELECT id, 'date', unnest(regexp_extract_all(text, '\\b(\\d{1,2}/\\d{1,2}/\\d{4})\\b', 1)), 1 FROM x", "arts"),
    "categorize": "WITH k AS (SELECT * FROM (VALUES ('bank', 'banking'), ('loan', 'banking'), ('tax', 'tax'), ('duty', 'tax'), ('the', 'family'), ('and', 'family'), ('de', 'civil'), ('la', 'civil'), ('der', 'labor'), ('die', 'labor'), ('que', 'real-estate'), ('el', 'real-estate')) t(word, category)), w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM documents), c AS (SELECT doc_id, category, count(*) AS score FROM w JOIN k USING (word) GROUP BY ALL) SELECT doc_id, category, score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) = 1",
    "sync_articles": sql("SELECT a.id, document_id, article_number, text, sort_key, chapter, path, slug, depth, title AS document_title, language AS document_language, type AS document_type, grp AS document_group, source_file FROM arts a LEFT JOIN docs d ON a.document_id = d.id WHERE synced IS NULL", "docs", "arts"),
    "sync_report": sql("SELECT count_if(synced IS NULL) AS pushed, CAST(0 AS BIGINT) AS pending, count(*) AS synced, count_if(synced IS NULL) AS stamped, TIMESTAMP '2024-01-01' AS newest FROM arts", "arts"),
    "webhook_fold": sql(f"{_LATEST} SELECT intent_id, status, ever_succeeded, failure_code, failure_message FROM t", "payment_events", "requests"),
    "webhook_stream": sql(f"{_LATEST.replace('FROM payment_events)', 'FROM payment_events WHERE event_id % 97 <> 0)')}, c AS (SELECT intent_id, count(*) AS events FROM e WHERE status IS NOT NULL GROUP BY intent_id) SELECT intent_id, status, ever_succeeded, failure_code, failure_message, events FROM t JOIN c USING (intent_id)", "payment_events", "requests"),
    "webhook_rejects": sql("SELECT CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE 'unknown type' END AS reason, count(*) + count_if(event_id % 97 <> 0 AND event_id % 10 = 0) AS lines FROM payment_events WHERE event_id % 97 = 0 OR type = 'other' GROUP BY ALL", "payment_events"),
    "case_state_stream": _FOLD,
    "case_services": f"{_ACTIONS} SELECT case_id, service_id, arg_max(moment, seq) AS completed_at FROM a WHERE action = 'toggle' GROUP BY ALL HAVING count(*) % 2 = 1",
    "case_services_stream": f"{_ACTIONS} SELECT case_id, service_id, arg_max(moment, seq) AS completed_at FROM a WHERE action = 'toggle' GROUP BY ALL HAVING count(*) % 2 = 1",
    "confirmation_stream": CONFIRMED,
    "notification_transitions": sql(f"SELECT id, ticket_number, CAST(CASE WHEN status = 'paid' AND id % 2 = 1 THEN 2 WHEN created_at < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS BIGINT) AS run FROM requests WHERE {_READY}", "requests"),
    "notification_messages": sql("SELECT ticket_number, (SELECT count(DISTINCT email) FROM users WHERE role = 'advisor') AS addresses FROM requests WHERE status = 'paid' AND id % 2 = 1", "requests", "users"),
}
