"""Streaming jobs: index sync, payment webhooks, case actions.

Each job has a stream form, and a query that runs it over the given tables with
an availableNow trigger. The folds are those of `states`.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators import corpus, payments
from quillwork.operators.sync import merged_index, unsynced_articles
from quillwork.sources import bindings as B
from quillwork.streaming import notify, states
from quillwork.streaming.index import BucketedTable

#: The JSON of a payment event.
WEBHOOK = "id string, ts timestamp_ntz, type string, data struct<object: struct<id: string, amount: bigint, currency: string, status: string, payment_method: string, payment_method_types: array<string>, last_payment_error: struct<code: string, message: string>, metadata: map<string, string>>>"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def webhook_source(lines: DataFrame, keep: list[str] = []) -> DataFrame:
    """Event rows from a stream or table of JSON lines (column value); broken lines have a null type. Columns of `keep` stay beside."""
    o = F.col("e.data.object")
    return lines.select(F.from_json("value", WEBHOOK).alias("e"), *keep).select(
        *keep,
        F.col("e.id").alias("event_id"),
        F.col("e.ts").alias("ts"),
        F.col("e.type").alias("type"),
        o["id"].alias("intent_id"),
        F.try_element_at(o["metadata"], F.lit("legal_aid_request_id")).cast("long").alias("request_id"),
        o["amount"].alias("amount_cents"),
        o["currency"].alias("currency"),
        o["payment_method"].alias("method"),
        o["payment_method_types"].alias("method_types"),
        o["last_payment_error"]["code"].alias("failure_code"),
        o["last_payment_error"]["message"].alias("failure_message"),
    )


def webhook_lines(events: DataFrame) -> DataFrame:
    """Payment events as the JSON lines that a webhook sends."""
    o = F.struct(
        F.col("intent_id").alias("id"),
        F.col("amount_cents").alias("amount"),
        "currency",
        F.col("method").alias("payment_method"),
        F.col("method_types").alias("payment_method_types"),
        F.when(F.col("failure_code").isNotNull(), F.struct(F.col("failure_code").alias("code"), F.col("failure_message").alias("message"))).alias("last_payment_error"),
        F.create_map(F.lit("legal_aid_request_id"), F.col("request_id").cast("string")).alias("metadata"),
    )
    return events.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), "ts", "type", F.struct(o.alias("object")).alias("data"))).alias("value"))


def webhook_events_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the table, written as JSON lines and read through the source's schema."""
    parsed = webhook_source(webhook_lines(B.payment_events(spark, sf_dir)))
    return parsed.select(F.col("event_id").cast("long").alias("event_id"), "type", "intent_id", "request_id", "amount_cents", "currency", "method", *payments.FAILURE)


FOLD = "intent_id string, status string, ever_succeeded boolean, failure_code string, failure_message string"


def _timed(rows: DataFrame, at: str, lateness: str | None) -> tuple[DataFrame, str, int | None]:
    """The rows with `at` in microseconds; with a lateness also a watermark, under which states expire."""
    moment = F.col(at).cast("timestamp")
    if lateness is None:
        return rows.withColumn("at", F.unix_micros(moment)), "None", None
    return rows.withColumns({"at": F.unix_micros(moment), "moment": moment}).withWatermark("moment", lateness), "EventTime", 1


def _when(column: str):
    return F.timestamp_micros(F.col(column)).cast("timestamp_ntz").alias(column)


def payment_states(events: DataFrame, requests: DataFrame, lateness: str | None = None, keep_days: int = 90, once: bool = False) -> DataFrame:
    """A streaming frame of each intent's state after every batch (update mode), with `events`, how many counted (0 unless `once`).

    A success of a known request begins an intent; the last event and the last
    failure since then are its state, in the order of (ts, event_id). With a
    lateness, events that are later than that are dropped, and an intent goes
    `keep_days` after its last event; without one states stay. With `once`,
    repeated deliveries of an event id are dropped and the others counted.
    """
    states.use_rocksdb(events.sparkSession)
    known = requests.select(F.col("id").alias("request_id"), F.lit(True).alias("k"))
    rows, mode, ends = _timed(events.where("intent_id IS NOT NULL"), "ts", lateness)
    own = ["intent_id", "event_id", "at", payments.state_of(F.col("type")).alias("status"), *payments.FAILURE] + (["moment"] if ends else [])
    rows = rows.join(known, "request_id", "left").select(*own, F.coalesce("k", F.lit(False)).alias("known"))
    fold = states.PaymentFold(keep_days * states.DAY_MS if ends else None, events.schema["event_id"].dataType.simpleString(), once)
    return rows.groupBy("intent_id").transformWithState(fold, f"{FOLD}, events long", "Update", mode)


def webhook_fold(events: DataFrame, requests: DataFrame) -> DataFrame:
    """A streaming frame of each intent's state after every batch (update mode).

    A success of a known request begins an intent; later events change it. The
    code and message of its last failure stay.
    """
    return payment_states(events, requests).drop("events")


def accepted_events(events: DataFrame) -> DataFrame:
    """Parsed events with a reason for those that no fold can take; null for the others."""
    none = lambda c: F.col(c).isNull()
    kinds = list(payments.STATES)
    reason = F.when(none("event_id") & none("type"), "broken").when(none("type") | ~F.col("type").isin(*kinds), "unknown type").when(none("event_id") | none("intent_id") | none("ts"), "incomplete")
    return events.withColumn("reason", reason)


def webhook_stream(lines: DataFrame, requests: DataFrame, place: str, lateness: str = "7 days", keep_days: int = 90) -> None:
    """JSON lines of payment events, end to end: each intent's states under place/out, lines that no fold takes under place/rejects.

    Two queries read the same lines; each has its own checkpoint, so both go on
    from where they were. Repeated deliveries of an event are dropped.
    """
    parsed = accepted_events(webhook_source(lines.select("value"), keep=["value"]))
    good = payment_states(parsed.where("reason IS NULL").drop("value", "reason"), requests, lateness, keep_days, once=True)
    run_now(good, f"{place}/out", "update", f"{place}/state")
    run_now(parsed.where("reason IS NOT NULL").select("reason", "event_id", "type", "value"), f"{place}/rejects", "append", f"{place}/rejects-state")


def run_now(stream: DataFrame, into: str, mode: str, state: str) -> None:
    """Runs a stream over what is there: every batch is written with its number."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{into}/n={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def _last_states(spark: SparkSession, place: str, schema: str, key: str, names: list[str]) -> DataFrame:
    """The state of the last batch in which each key changed."""
    saved = spark.read.schema(f"{schema}, batch int").parquet(f"{place}/out")
    return saved.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("s")).select(key, "s.*")


#: Rows a file of the registered runs' batches, about: a batch of more rows is several files, so that no task writes or reads it all.
FILE_ROWS = 250_000


def _files(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def _streamed(rows: DataFrame, place: str, batches: int = 2) -> DataFrame:
    """Rows as a stream of files, as many a batch as its rows need."""
    files = _files(rows.count() // batches)
    rows.repartition(batches * files).write.parquet(f"{place}/in")
    schema = rows.sparkSession.read.parquet(f"{place}/in").schema
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")


#: Registered runs cut tables into files in no order of time, so no event may count as late.
ANY_TIME = "36500 days"


def webhook_fold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of the table's events as a stream of several batches; the last state of each intent."""
    place = shared_place(spark, "webhook")
    events = _streamed(B.payment_events(spark, sf_dir), place)
    run_now(webhook_fold(events, B.requests(spark, sf_dir)), f"{place}/out", "update", f"{place}/state")
    return _last_states(spark, place, FOLD, "intent_id", ["status", "ever_succeeded", *payments.FAILURE])


def _webhooks(spark: SparkSession, sf_dir: str) -> str:
    """Runs the table's events as JSON lines through the stream; some lines are broken, some delivered again in another file."""
    place = shared_place(spark, "webhook")
    lines = webhook_lines(B.payment_events(spark, sf_dir)).withColumn("n", F.get_json_object("value", "$.id").cast("long"))
    sent = lines.select(F.when(F.col("n") % 97 == 0, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value"))
    again = lines.where("n % 10 = 0 AND n % 97 <> 0").select("value")
    files = _files(lines.count() // 2)
    sent.repartition(2 * files).write.text(f"{place}/in")
    again.repartition(files).write.mode("append").text(f"{place}/in")
    stream = spark.readStream.option("maxFilesPerTrigger", files).text(f"{place}/in")
    webhook_stream(stream, B.requests(spark, sf_dir), place, ANY_TIME)
    return place


def webhook_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each intent and its number of different events, from JSON lines."""
    return _last_states(spark, _webhooks(spark, sf_dir), f"{FOLD}, events long", "intent_id", ["status", "ever_succeeded", *payments.FAILURE, "events"])


def webhook_rejects_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reason, lines: what the stream of JSON lines could not take."""
    rejects = spark.read.schema("reason string, event_id string, type string, value string, batch int").parquet(f"{_webhooks(spark, sf_dir)}/rejects")
    return rejects.groupBy("reason").agg(F.count("*").alias("lines"))


def sync_articles(articles: DataFrame, documents: DataFrame, index: str, state: str) -> None:
    """Puts a stream of unsynced articles into an index kept as versioned Parquet; for small indexes (see sync_incremental).

    Every batch writes a new version, the old one with the batch's records in
    place of those of the same ids; a batch that is run again writes the same.
    """
    spark = documents.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        records = corpus.searchable_articles(documents, batch)
        old = f"{index}/version={number - 1}"
        now = merged_index(spark.read.schema(records.schema).parquet(old), records) if number else records
        now.write.mode("overwrite").parquet(f"{index}/version={number}")

    unsynced_articles(articles).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


RECORD = "id string, document_id long, article_number string, text string, sort_key int, chapter string, path string, slug string, depth int, document_title string, document_language string, document_type string, document_group string, source_file string"


def sync_incremental(articles: DataFrame, documents: DataFrame, index: BucketedTable, state: str, clock: Callable[[], dt.datetime] | None = None) -> None:
    """Puts a stream of unsynced articles into a bucketed index: a batch writes what it touches, with its stamp and count.

    The job's name is its checkpoint, so batches that are run again, by this
    stream or after a failure, change nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        now = clock() if clock else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        index.merge(corpus.searchable_articles(documents, batch), state, number, now)

    unsynced_articles(articles).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def stamped_articles(articles: DataFrame, index: BucketedTable) -> DataFrame:
    """The articles with the stamps of the index: those that it holds are synced, at the time of their batch; others keep theirs."""
    before = F.col("synced_at") if "synced_at" in articles.columns else F.lit(None).cast("timestamp_ntz")
    stamps = index.live().select(F.col("id").alias("pushed_id"), F.col("synced_at").alias("pushed_at"))
    rows = articles.join(stamps, F.col("id") == F.col("pushed_id"), "left")
    pushed = F.col("pushed_id").isNotNull()
    return rows.withColumns({"synced_at": F.when(pushed, F.col("pushed_at")).otherwise(before), "synced": F.when(pushed, F.lit(True)).otherwise(F.col("synced"))}).drop("pushed_id", "pushed_at")


#: The time of the registered runs of the sync, whose stamps have to be the same each time.
SYNCED_AT = dt.datetime(2024, 1, 1)
#: Files and so batches that the registered runs cut the table into.
SYNC_BATCHES = 3


def _synced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, BucketedTable]:
    """The table's articles, and the index that a stream over them leaves after SYNC_BATCHES batches."""
    place = shared_place(spark, "sync")
    rows = B.articles(spark, sf_dir)
    files = _files(rows.count() // SYNC_BATCHES)
    rows.repartition(SYNC_BATCHES * files, "document_id").write.parquet(f"{place}/in")
    articles = spark.read.parquet(f"{place}/in")
    stream = spark.readStream.schema(articles.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    index = BucketedTable(spark, f"{place}/index", RECORD, compact_after=2)
    sync_incremental(stream, B.documents(spark, sf_dir), index, f"{place}/state", lambda: SYNCED_AT)
    return articles, index


def sync_articles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of the sync over the table's articles, in several batches: the index that it leaves."""
    return _synced(spark, sf_dir)[1].live().drop("synced_at", "version")


def sync_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row after the run: records pushed by all batches, articles that wait and that are synced, and the newest stamp."""
    articles, index = _synced(spark, sf_dir)
    pushed = index.log().agg(F.sum("pushed").alias("pushed"))
    after = stamped_articles(articles, index).agg(F.count_if(F.col("synced").isNull()).alias("pending"), F.count_if(F.col("synced").isNotNull()).alias("synced"), F.count("synced_at").alias("stamped"), F.max("synced_at").alias("newest"))
    return pushed.crossJoin(F.broadcast(after))  # one row each


CASE = "case_id long, advisor_id long, first_contact_at timestamp_ntz, case_status string, closed_at timestamp_ntz, last_touched_at timestamp_ntz, completed long"
CASE_TIMES = ("first_contact_at", "closed_at", "last_touched_at")


def case_state_stream(actions: DataFrame, lateness: str | None = None, keep_days: int = 730) -> DataFrame:
    """A streaming frame of each case's state after every batch (update mode), with the services that the batch changed.

    `changed` has (service_id, completed_at) of each service that was toggled,
    completed_at null where it is open again. With a lateness, actions later
    than that are dropped and a case goes `keep_days` after its last action.
    """
    states.use_rocksdb(actions.sparkSession)
    rows, mode, ends = _timed(actions.withColumnRenamed("at", "acted_at"), "acted_at", lateness)
    rows = rows.select("case_id", "seq", "at", "action", F.col("service_id").cast("long").alias("service_id"), F.col("user_id").cast("long").alias("user_id"), *(["moment"] if ends else []))
    schema = CASE.replace("timestamp_ntz", "long") + ", changed array<struct<service_id: bigint, completed_at: bigint>>"
    folded = rows.groupBy("case_id").transformWithState(states.CaseFold(keep_days * states.DAY_MS if ends else None), schema, "Update", mode)
    names = [f.split()[0] for f in CASE.split(", ")]
    changed = F.transform("changed", lambda c: F.struct(c["service_id"].alias("service_id"), F.timestamp_micros(c["completed_at"]).cast("timestamp_ntz").alias("completed_at")))
    return folded.select(*[_when(c) if c in CASE_TIMES else F.col(c) for c in names], changed.alias("changed"))


CHANGED = "changed array<struct<service_id: bigint, completed_at: timestamp_ntz>>"


def _cases(spark: SparkSession, sf_dir: str) -> str:
    from quillwork.plans.payments import actions

    place = shared_place(spark, "cases")
    run_now(case_state_stream(_streamed(actions(spark, sf_dir), place)), f"{place}/out", "update", f"{place}/state")
    return place


def case_state_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case fold as a stream over the table's actions; the last state of each case."""
    names = [f.split()[0] for f in CASE.split(", ")][1:]
    return _last_states(spark, _cases(spark, sf_dir), f"{CASE}, {CHANGED}", "case_id", names)


def case_services_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, service_id, completed_at of the services that the stream leaves completed."""
    saved = spark.read.schema(f"{CASE}, {CHANGED}, batch int").parquet(f"{_cases(spark, sf_dir)}/out")
    rows = saved.select("case_id", "batch", F.explode("changed").alias("c")).select("case_id", "batch", "c.*")
    last = rows.groupBy("case_id", "service_id").agg(F.max_by(F.struct("completed_at"), "batch").alias("s"))
    return last.select("case_id", "service_id", "s.completed_at").where("completed_at IS NOT NULL")


#: Groups of tokens that share a state.
GROUPS = 4096
CLOCK = "token long, attempt_id long, at timestamp_ntz, outcome string"


def confirmation_stream(events: DataFrame, lateness: str = "1 day", keep_days: int = 30, groups: int = GROUPS) -> DataFrame:
    """token, attempt_id, at, outcome: the answer to every attempt (ok, expired, invalid), and a row without attempt where a token expires unconfirmed.

    events: token, kind (created or confirm), attempt_id, at, expires_at. An
    attempt is judged as `confirmation_state` does at its time. Expiry is told
    when the watermark passes it; a token answers late attempts for `keep_days`
    more, then it is unknown. Tokens are dealt into `groups` by hash.
    """
    states.use_rocksdb(events.sparkSession)
    rows, mode, _ = _timed(events.withColumnRenamed("at", "tried_at"), "tried_at", lateness)
    rows = rows.select(F.pmod(F.xxhash64("token"), F.lit(groups)).alias("part"), "token", "kind", "attempt_id", "at", F.unix_micros(F.col("expires_at").cast("timestamp")).alias("expires_at"), "moment")
    told = rows.groupBy("part").transformWithState(states.ConfirmationClock(keep_days * states.DAY_MS), "token long, attempt_id long, at long, outcome string", "Append", mode)
    return told.select("token", "attempt_id", _when("at"), "outcome")


def confirmation_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the table's confirmations and attempts: token, attempt_id, outcome."""
    from quillwork.plans.booking import confirmation_events

    place = shared_place(spark, "confirmations")
    events = confirmation_events(spark, sf_dir)
    first, last = events.agg(F.min("at"), F.max("at")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)] if first else []
    bounds = list(zip([None, *cuts], [*cuts, None]))
    inside = [(F.lit(True) if low is None else F.col("at") >= low) & (F.lit(True) if high is None else F.col("at") < high) for low, high in bounds]
    counts = events.agg(*[F.count_if(own).alias(str(n)) for n, own in enumerate(inside)]).first()
    files = _files(max(counts)) if min(counts) > 100 * _files(max(counts)) else 1  # as many in every batch, none of them empty
    for own in inside:  # batches in the order of time
        events.where(own).repartition(files).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    run_now(confirmation_stream(stream), f"{place}/out", "append", f"{place}/state")
    return spark.read.schema(f"{CLOCK}, batch int").parquet(f"{place}/out").select("token", "attempt_id", "outcome")


def _announced(spark: SparkSession, sf_dir: str) -> BucketedTable:
    """Three runs over the table's requests: at first only the older ones are there, and every second paid one is not paid yet."""
    log = BucketedTable(spark, f"{shared_place(spark, 'notify')}/log", notify.CASES, compact_after=2)
    requests, users = B.requests(spark, sf_dir), B.users(spark, sf_dir)
    late = (F.col("status") == "paid") & (F.col("id") % 2 == 1)
    before = requests.withColumn("status", F.when(late, "pending_payment").otherwise(F.col("status")))
    old = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    for run, now in enumerate((before.where(old), before, requests)):
        notify.announce(now, users, log, "notify", run, SYNCED_AT)
    return log


def notification_transitions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ticket_number, run: every ready case, at the run that first saw it ready."""
    return notify.announced(_announced(spark, sf_dir)).select("id", "ticket_number", F.col("version").alias("run"))


def notification_messages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticket_number, addresses: how many the last run's messages of each case reach, expanded in two parts."""
    log = _announced(spark, sf_dir)
    parts = [notify.messages(log, 2, k, 2) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("ticket_number").agg(F.sum("addresses").alias("addresses"))
