"""Advisor cases: filters, pages, progress, dashboards, notifications.

Counts of a dashboard are one pass of conditional aggregates. Pages end their
order with the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import like_any
from quillwork.operators.corpus import page_of

VISIBLE = ("paid", "confirmed", "pending")
STALE_DAYS = 7


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 of nothing."""
    return F.when(whole > 0, F.round(part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)"), 0).cast("long")).otherwise(F.lit(0).cast("long"))


def priced(base: Column) -> Column:
    return base.isNull() | (base > 0)


def visible_cases(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("status").isin(*VISIBLE))


def case_search(requests: DataFrame, term: str) -> DataFrame:
    term = term.strip()
    return requests.where(like_any(["ticket_number", "full_name", "email", "phone", "whatsapp"], term)) if term else requests


def case_filter_status(requests: DataFrame, status: str | None) -> DataFrame:
    """open or closed; anything else filters nothing."""
    return requests.where(F.col("case_status") == status) if status in ("open", "closed") else requests


def case_filter_payment(requests: DataFrame, kind: str | None) -> DataFrame:
    base = F.col("base_price")
    kinds = {"free": base == 0, "paid": F.col("status") == "paid", "confirmed": (F.col("status") == "confirmed") & priced(base)}
    return requests.where(kinds[kind]) if kind in kinds else requests


def case_filter_advisor(requests: DataFrame, advisor: str | int | None) -> DataFrame:
    if advisor == "unclaimed":
        return requests.where("advisor_id IS NULL")
    return requests if advisor is None else requests.where(F.col("advisor_id") == int(advisor))


def case_filter_service(requests: DataFrame, pairs: DataFrame, service_id: int | None) -> DataFrame:
    if not service_id:
        return requests
    wanted = pairs.where(F.col("service_id") == service_id).select(F.col("request_id").alias("id"))
    return requests.join(wanted, "id", "left_semi")


def case_page(requests: DataFrame, page: int = 1, per_page: int = 4) -> DataFrame:
    """Closed cases first, then the oldest."""
    return page_of(requests, ["case_status", "created_at", "id"], page, per_page)


def _counts(mine: Column) -> dict[str, Column]:
    opened = F.col("case_status") == "open"
    return {"open": opened, "closed": F.col("case_status") == "closed", "unclaimed": F.col("advisor_id").isNull(), "mine": mine, "my_open": mine & opened}


def case_page_strip(page: DataFrame, advisor: int) -> DataFrame:
    """One row of counts over a page only."""
    counts = _counts(F.coalesce(F.col("advisor_id") == advisor, F.lit(False)))
    return page.agg(*[F.count_if(c).alias(n) for n, c in counts.items() if n != "my_open"])


def advisor_dashboard(requests: DataFrame, advisor: int) -> DataFrame:
    counts = _counts(F.coalesce(F.col("advisor_id") == advisor, F.lit(False)))
    return visible_cases(requests).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def advisor_dashboard_all(requests: DataFrame) -> DataFrame:
    """Cases and open cases of every advisor."""
    claimed = visible_cases(requests).where("advisor_id IS NOT NULL")
    return claimed.groupBy("advisor_id").agg(F.count("*").alias("mine"), F.count_if(F.col("case_status") == "open").alias("my_open"))


def selected_services(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """request_id, service_id, completed_at: the listed services, else the single legacy one."""
    legacy = requests.where("service_id IS NOT NULL").select(F.col("id").alias("request_id"), "service_id").join(pairs.select("request_id"), "request_id", "left_anti")
    known = pairs.join(requests.select(F.col("id").alias("request_id")), "request_id", "left_semi")
    return known.select("request_id", "service_id", "completed_at").unionByName(legacy.withColumn("completed_at", F.lit(None).cast("timestamp_ntz")))


def completed_services(selected: DataFrame) -> DataFrame:
    return selected.where("completed_at IS NOT NULL")


def missing_services(selected: DataFrame) -> DataFrame:
    return selected.where("completed_at IS NULL")


def task_progress(requests: DataFrame, selected: DataFrame) -> DataFrame:
    """id, total, done, percent of every case; zeros without services."""
    sums = selected.groupBy("request_id").agg(F.count("*").alias("total"), F.count("completed_at").alias("done"))
    rows = requests.join(sums, requests["id"] == sums["request_id"], "left").select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("done", F.lit(0)).alias("done"))
    return rows.withColumn("percent", percent(F.col("done"), F.col("total")))


def fully_completed(selected: DataFrame) -> DataFrame:
    """Requests with services, all of them completed."""
    return selected.groupBy("request_id").agg(F.bool_and(F.col("completed_at").isNotNull()).alias("all")).where("all").select("request_id")


def dashboard_percentages(requests: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: open, closed and task percentages of the visible cases."""
    seen = visible_cases(requests)
    tasks = selected.join(seen.select(F.col("id").alias("request_id")), "request_id", "left_semi").agg(F.count("*").alias("tasks"), F.count("completed_at").alias("done"))
    row = seen.agg(F.count("*").alias("n"), F.count_if(F.col("case_status") == "open").alias("o"), F.count_if(F.col("case_status") == "closed").alias("c")).crossJoin(F.broadcast(tasks))  # one row each
    return row.select(percent(F.col("o"), F.col("n")).alias("open_percent"), percent(F.col("c"), F.col("n")).alias("closed_percent"), percent(F.col("done"), F.col("tasks")).alias("tasks_percent"))


def services_summary(selected: DataFrame, services: DataFrame) -> DataFrame:
    """request_id, names: the services' names by id, joined."""
    named = selected.join(services.select(F.col("id").alias("service_id"), "name_en"), "service_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("service_id", "name_en"))), lambda x: x["name_en"])
    return named.groupBy("request_id").agg(F.array_join(names, ", ").alias("names"))


def recent_cases(requests: DataFrame, most: int = 5) -> DataFrame:
    return visible_cases(requests).orderBy(F.desc("created_at"), "id").limit(most)


def stale_cases(requests: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    return requests.where(F.col("last_touched_at") < now - F.make_dt_interval(F.lit(days)))


def case_notes_timeline(notes: DataFrame, users: DataFrame, request_id: int) -> DataFrame:
    """A case's notes, newest first, with their authors; notes without one stay."""
    authors = users.select(F.col("id").alias("user_id"), F.col("name").alias("author"))
    return notes.where(F.col("request_id") == request_id).join(authors, "user_id", "left").select("id", "note", "author", "created_at").orderBy(F.desc("created_at"), "id")


def claim_state(requests: DataFrame, advisor: int) -> DataFrame:
    state = F.when(F.col("advisor_id").isNull(), "unclaimed").when(F.col("advisor_id") == advisor, "mine").otherwise("other")
    return requests.select("id", state.alias("claim"))


def notes_total(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("notes"))


def advisor_directory(users: DataFrame, page: int | None = None, per_page: int = 5) -> DataFrame:
    rows = users.where("role = 'advisor'").select("id", "name", "email")
    return page_of(rows, ["name", "id"], page, per_page) if page else rows.orderBy("name", "id")


def service_directory(services: DataFrame) -> DataFrame:
    return services.select("id", "name_en").orderBy("name_en", "id")


def ready_cases(requests: DataFrame) -> DataFrame:
    """Cases that advisors are told of: free at booking, paid, or confirmed and not free."""
    base = F.col("base_price")
    return requests.where(((base == 0) & (F.col("status") == "pending")) | (F.col("status") == "paid") | ((F.col("status") == "confirmed") & priced(base)))


#: Rows of the fanout that a task gives, and addresses of one task: with about 250 a Parquet file of the rows is smallest.
PAIRS, ADDRESSES = 5_000_000, 250


def notification_fanout(requests: DataFrame, users: DataFrame, most: int = ADDRESSES, pairs: int = PAIRS) -> DataFrame:
    """ticket_number, email: every ready case with every advisor's address.

    The result is this product by definition. Addresses are dealt into blocks
    of about `most`, cases into blocks that give about `pairs` rows with one of
    them, and a task joins two blocks. Each row of either side is written to the
    shuffle once and read again by every task of its block; nothing is copied or
    broadcast.
    """
    emails = users.where("role = 'advisor' AND email IS NOT NULL").select("email")
    ready = ready_cases(requests).select("ticket_number")
    addresses = emails.count()
    blocks = max(1, -(-addresses // most))
    tasks = max(1, -(-ready.count() * addresses // (blocks * pairs)))
    return ready.repartition(tasks).crossJoin(emails.repartition(blocks).hint("shuffle_replicate_nl"))


# --- admin analytics -------------------------------------------------------


def payment_split(requests: DataFrame) -> DataFrame:
    base = F.col("base_price")
    return requests.agg(
        F.count_if((F.col("status") == "paid") & priced(base)).alias("google_pay_paid"),
        F.count_if((F.col("status") == "confirmed") & priced(base)).alias("bank_confirmed"),
        F.count_if(base == 0).alias("free"),
    )


def paid_share(requests: DataFrame) -> DataFrame:
    """The split with the share of paid among paid and free, in percent."""
    split = payment_split(requests).withColumn("paid", F.col("google_pay_paid") + F.col("bank_confirmed"))
    return split.select("paid", "free", percent(F.col("paid"), F.col("paid") + F.col("free")).alias("paid_percent"))


def admin_kpis(requests: DataFrame, users: DataFrame) -> DataFrame:
    people = users.agg(F.count("*").alias("users"))
    return requests.agg(F.count_if(F.col("status").isin("pending_payment", "pending")).alias("pending"), F.count_if(F.col("status") == "confirmed").alias("confirmed")).crossJoin(F.broadcast(people))  # one row each


def recent_requests(requests: DataFrame, most: int = 5) -> DataFrame:
    return requests.orderBy(F.desc("created_at"), "id").limit(most)


def admin_requests(requests: DataFrame, pairs: DataFrame, services: DataFrame, page: int = 1, per_page: int = 5) -> DataFrame:
    """A page of requests, newest first, with their services' names: only the page's rows are joined."""
    rows = page_of(requests, ["created_at desc", "id"], page, per_page)
    mine = pairs.join(F.broadcast(rows.select(F.col("id").alias("request_id"))), "request_id", "left_semi")  # a page
    names = services_summary(mine, services)
    return rows.join(names, rows["id"] == names["request_id"], "left").select("id", "ticket_number", "status", F.coalesce("names", F.lit("")).alias("services"))


def users_latest(users: DataFrame, most: int | None = None) -> DataFrame:
    """Every user, newest first; of those the first `most`, if given."""
    rows = users.select("id", "name", "role").orderBy(F.desc("id"))
    return rows if most is None else rows.limit(most)


CUSTOM_BAR = "__custom_bar__"


def bar_list(users: DataFrame, defaults: list[str]) -> DataFrame:
    """bar, place: the defaults in their order, then the other saved bars by name; each once."""
    spark = users.sparkSession
    first = spark.createDataFrame([(b, n) for n, b in enumerate(defaults)], "bar string, place long")
    saved = users.select(F.btrim("bar").alias("bar")).where((F.col("bar") != "") & (F.col("bar") != CUSTOM_BAR)).distinct()
    more = saved.join(F.broadcast(first), "bar", "left_anti").withColumn("place", F.lit(len(defaults)).cast("long"))
    return first.unionByName(more).orderBy("place", "bar")


def role_labels(users: DataFrame) -> DataFrame:
    return users.select("id", F.when(F.col("role") == "admin", "Admin").when(F.col("role") == "advisor", "Advisor").otherwise("User").alias("label"))


def status_labels(requests: DataFrame) -> DataFrame:
    words = F.initcap(F.replace("status", F.lit("_"), F.lit(" ")))
    return requests.select("id", F.when(F.col("base_price") == 0, "Free").otherwise(words).alias("label"))


def request_timeline(requests: DataFrame) -> DataFrame:
    """A row a step that happened: Submitted, Paid, Confirmed."""
    steps = requests.selectExpr("id", "stack(3, 'Submitted', created_at, 'Paid', paid_at, 'Confirmed', confirmed_at) AS (step, at)")
    return steps.where("at IS NOT NULL")
