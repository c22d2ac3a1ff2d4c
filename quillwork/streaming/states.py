"""Keyed states of the streams, folded one event at a time.

Each fold keeps the greatest or least event of a kind by its place in the order,
so its result doesn't depend on how events are cut into batches or ordered in
them, repeated events change nothing, and what is held for a key doesn't grow
with a batch. Times are microseconds. Where a stream has a watermark, a state
that has seen no event for its time to live goes by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Ids of events that a state holds in one value.
FEW = 1024


def use_rocksdb(spark: SparkSession) -> None:
    """States of these streams need a store that holds several of them a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Expiring(StatefulProcessor):
    """A processor whose key goes `keep_ms` after the latest event time that it saw; never if that is None."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def touched(self, at: int | None) -> None:
        """The key's timer moves behind an event at `at` microseconds."""
        if self.keep_ms is None or at is None:
            return
        old = self.timer.get()[0] if self.timer.exists() else None
        new = at // 1000 + self.keep_ms
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
            self.timer.update((new,))

    def clear(self) -> None:
        self.timer.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


class PaymentFold(StatefulProcessor):
    """An intent's state: begun by the first success of a known request; its last event and last failure.

    Rows: at, event_id, status (null for kinds that change nothing), known,
    failure_code, failure_message. With `once`, events are counted, each id once.
    All of an intent is one value, read and written once a batch, with its last
    ids up to `few`; ids beyond go into a map. `ends` is when it is forgotten: a
    timer that fires before that is set anew.
    """

    def __init__(self, keep_ms: int | None, id_type: str, once: bool, few: int = FEW):
        self.keep_ms, self.id_type, self.once, self.few = keep_ms, id_type, once, few

    def init(self, handle) -> None:
        self.handle, t = handle, self.id_type
        self.fold = handle.getValueState("fold", f"first_at long, first_id {t}, last_at long, last_id {t}, status string, failed_at long, failed_id {t}, code string, message string, events long, ends long, recent array<{t}>")
        if self.once:
            self.seen = handle.getMapState("seen", f"event_id {t}", "there boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = last = failed = status = code = message = ends = None
        events, latest, recent = 0, None, set()
        held = self.fold.get()
        if held is not None:
            a, b, c, d, status, e, f, code, message, events, ends, recent = held
            first, last, failed = (None if at is None else (at, n) for at, n in ((a, b), (c, d), (e, f)))
            recent = set(recent)
        for r in rows:
            if r.status is None:
                continue
            latest = r.at if latest is None else max(latest, r.at)
            if self.once:
                if r.event_id in recent or (events > len(recent) and self.seen.containsKey((r.event_id,))):
                    continue
                recent.add(r.event_id)
                events += 1
                if len(recent) > self.few:
                    for n in recent:
                        self.seen.updateValue((n,), (True,))
                    recent = set()
            place = (r.at, r.event_id)
            if r.status == "succeeded" and r.known and (first is None or place < first):
                first = place
            if last is None or place > last:
                last, status = place, r.status
            if r.status == "failed" and (failed is None or place > failed):
                failed, code, message = place, r.failure_code, r.failure_message
        if last is None:
            return
        if self.keep_ms is not None and latest is not None:
            new = latest // 1000 + self.keep_ms
            if ends is None:
                self.handle.registerTimer(new)
            ends = new if ends is None else max(ends, new)
        none = (None, None)
        self.fold.update((*(first or none), *last, status, *(failed or none), code, message, events, ends, sorted(recent)))
        if first is not None:
            told = failed is not None and failed >= first
            yield Row(intent_id=key[0], status=status, ever_succeeded=True, failure_code=code if told else None, failure_message=message if told else None, events=events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.fold.get()
        if held is not None and held[10] > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(held[10])
        elif held is not None:
            self.fold.clear()
            if self.once:
                self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class CaseFold(Expiring):
    """A case's state, and for each of its services how often and when last it was toggled.

    Rows: seq, at, action, service_id, user_id. `changed` of a result row has
    the batch's toggled services, with the time of completion or null.
    """

    def init(self, handle) -> None:
        super().init(handle)
        self.case = handle.getValueState("case", "claim_seq long, advisor long, contact long, turn_seq long, closed boolean, turned long, last long, completed long")
        self.services = handle.getMapState("services", "service string", "toggles long, seq long, at long")

    def clear(self) -> None:
        super().clear()
        self.case.clear()
        self.services.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        claim_seq, advisor, contact, turn_seq, closed, turned, last, completed = self.case.get() if self.case.exists() else (None, None, None, None, False, None, None, 0)
        toggled: dict[str, tuple] = {}  # this batch's services of the case
        for r in rows:
            last = r.at if last is None else max(last, r.at)
            if r.action == "toggle":
                name = "" if r.service_id is None else str(r.service_id)
                if name not in toggled:
                    toggled[name] = tuple(self.services.getValue((name,))) if self.services.containsKey((name,)) else (0, None, None)
                    completed -= toggled[name][0] % 2
                n, seq, at = toggled[name]
                toggled[name] = (n + 1, *((seq, at) if seq is not None and seq > r.seq else (r.seq, r.at)))
            elif r.action == "claim" and (claim_seq is None or r.seq < claim_seq):
                claim_seq, advisor, contact = r.seq, r.user_id, r.at
            elif r.action in ("close", "reopen") and (turn_seq is None or r.seq > turn_seq):
                turn_seq, closed, turned = r.seq, r.action == "close", r.at
        changed = []
        for name, state in toggled.items():
            self.services.updateValue((name,), state)
            completed += state[0] % 2
            changed.append(Row(service_id=int(name) if name else None, completed_at=state[2] if state[0] % 2 else None))
        self.case.update((claim_seq, advisor, contact, turn_seq, closed, turned, last, completed))
        self.touched(last)
        yield Row(case_id=key[0], advisor_id=advisor, first_contact_at=contact, case_status="closed" if closed else "open", closed_at=turned if closed else None, last_touched_at=last, completed=completed, changed=changed)


class ConfirmationClock(StatefulProcessor):
    """Tokens between their creation and their end: confirmed in time, or expired by a timer.

    Rows: token, kind (created or confirm), attempt_id, at, expires_at. The
    earliest attempt in time confirms; what a batch brings is taken by time. A
    token answers `keep_ms` after it expired, then it is forgotten.

    A key is a group of tokens, whose states are read and written as one list a
    batch, with a timer at the first moment when one of them is due.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.tokens = handle.getListState("tokens", "token long, expires long, confirmed boolean, told boolean, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {t[0]: tuple(t)[1:] for t in self.tokens.get()}
        made: dict[int, list] = {}
        attempts: dict[int, list] = {}  # the attempts on a group's tokens in one batch: few, and numbers only
        for r in rows:
            if r.kind != "created":
                attempts.setdefault(r.token, []).append((r.at, r.attempt_id))
            else:
                made.setdefault(r.token, []).append(r.expires_at)
        dues = []
        for token in made.keys() | attempts.keys():
            fresh = token not in held
            exists = not fresh or token in made
            expires, confirmed, told, due = (None, False, False, None) if fresh else held[token]
            for ends in made.get(token, ()):
                expires = expires if not fresh and expires is not None else ends
            for at, attempt in sorted(attempts.get(token, ())):
                if not exists or confirmed:
                    outcome = "invalid"
                elif expires is None or expires < at:
                    outcome = "expired"
                else:
                    outcome, confirmed = "ok", True
                yield Row(token=token, attempt_id=attempt, at=at, outcome=outcome)
            if not exists:
                continue
            if expires is None and not told:
                told = True
                yield Row(token=token, attempt_id=None, at=None, outcome="expired")
            if fresh and expires is not None:
                due = expires // 1000 + 1
                dues.append(due)
            held[token] = (expires, confirmed, told, due)
        self._keep(held, dues)

    def _keep(self, held: dict[int, tuple], dues: list[int]) -> None:
        """Writes the list; some timer is never later than what is due first."""
        if held:
            self.tokens.put([(token, *state) for token, state in held.items()])
        else:
            self.tokens.clear()
        if dues:
            self.handle.registerTimer(min(dues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held, before = {}, 0
        for token, expires, confirmed, told, due in self.tokens.get():
            before += 1
            if due is None or due > now:
                held[token] = (expires, confirmed, told, due)
            elif not confirmed and not told:
                held[token] = (expires, confirmed, True, max(due + self.keep_ms, now + 1))  # not within this batch
                yield Row(token=token, attempt_id=None, at=expires, outcome="expired")
        if before:
            self._keep(held, [s[3] for s in held.values() if s[3] is not None])

    def close(self) -> None:
        pass
