"""Repair of conversation structure: the cheapest edits that make roles alternate.

A conversation's turns are edited (K keep, R rerole, D delete, I insert) until
their role initials read `(s?(ua)+)?`. The edits are a path through a DAG whose
nodes are (turn, state of that pattern). A path has one scalar weight: its high
digits are the cost, its low digits the letters of its edits, three bits each
(D, I, K, R are 1 to 4) in places of fixed width from the front, with zeros
behind the last letter. So the smaller integer is the cheaper path, among equal
costs the one whose letters come first in ASCII, and an ordinary minimum of
integers decides everything; the letters are read off the winner's low digits.

Turns are dealt by range of (conversation, turn), so a long conversation lies
in many tasks. Each task cuts it into pieces of at most PIECE turns. A piece's
weights are known for each state before and behind it; pieces are joined by the
same minimum, with the rank of what follows as the last digit. Inserts stand
before a turn, or behind the last one: so a piece's letters end with a turn's
and none is the beginning of another. A conversation that lies in one task and
one piece is done there; only the others are shuffled again, as pieces.

What is sequential by nature is so only in pieces: the digest of a repaired
conversation is fed piece by piece, of which no task holds more than one batch.

Edge cases: a null role or text is one space; null turns come first; rows of
one turn are ordered by role and text; repeated rows are duplicates; a null
conv_id is a conversation; an empty role has no initial, so it is reroled or
deleted; a conversation without turns costs nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.shared import table, written

REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
D, I, K, R = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR")
SPACE = " \t\n\x0b\x0c\r"
PIECE, PIECE_BYTES = 256, 1 << 20
NEVER = 1 << 62

#: States: nothing yet, after s, after u, after a; where each initial leads from them.
GOES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
#: The role that an inserted or reroled turn takes in each state.
WANTED = ("u", "u", "a", "u")
#: (state, inserts) that inserts lead to from each state, and the inserts that end a conversation there.
INSERTED = (((0, 0), (2, 1), (3, 2)), ((1, 0), (2, 1), (3, 2)), ((2, 0), (3, 1)), ((3, 0), (2, 1)))
ENDING = (0, 2, 1, 0)


@lru_cache(maxsize=None)
def moves(state: int, initial: str, gone: bool, unfinished: bool) -> list[tuple[int, int, int, int]]:
    """(next state, cost, letters as digits, how many) of all edits of a turn, inserts before it included."""
    found = []
    for at, inserts in INSERTED[state]:
        before = sum(I << 3 * k for k in range(inserts)) << 3
        cost, n = inserts * INSERT, inserts + 1
        found.append((at, cost + DELETE, before | D, n))
        if not gone:
            extra = UNFINISHED if unfinished else 0
            if initial in GOES[at]:
                found.append((GOES[at][initial], cost + extra, before | K, n))
            found.append((GOES[at][WANTED[at]], cost + extra + REROLE, before | R, n))
    return found


def suffix_weights(kinds: list[tuple[str, bool, bool]], ends: list[int | None], bits: int) -> list[int | None]:
    """The least weight from each state through all turns to `ends`; letters fill `bits` low bits."""
    mask, now = (1 << bits) - 1, ends
    for kind in reversed(kinds):
        before = []
        for state in range(4):
            best = None
            for to, cost, digits, n in moves(state, *kind):
                rest = now[to]
                if rest is not None:
                    weight = ((rest >> bits) + cost << bits) | digits << bits - 3 * n | (rest & mask) >> 3 * n
                    if best is None or weight < best:
                        best = weight
            before.append(best)
        now = before
    return now


def places(turns: int) -> int:
    """Bits for the letters of so many turns: two inserts before each and behind the last."""
    return 9 * turns + 6


def letters_of(weight: int, bits: int) -> str:
    return format(weight & (1 << bits) - 1, "o").zfill(bits // 3).rstrip("0").translate(LETTERS)


def whole_weight(kinds: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of a whole conversation."""
    bits = places(len(kinds))
    ends = [k * INSERT << bits | sum(I << bits - 3 * (j + 1) for j in range(k)) for k in ENDING]
    best = suffix_weights(kinds, ends, bits)[0]
    return best >> bits, letters_of(best, bits)


def piece_weights(kinds: list[tuple[str, bool, bool]]) -> list[list[int | None]]:
    """[state behind][state before] -> the least weight of a piece."""
    bits = places(len(kinds))
    return [suffix_weights(kinds, [0 if s == end else None for s in range(4)], bits) for end in range(4)]


def backward(turns: int, weights: list[list[int | None]], after: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """The state behind a piece for each state before it, and (cost, rank) from there; after: the same behind the piece."""
    bits = places(turns)
    letters = (1 << bits) - 1
    ends, found = [], []
    for state in range(4):
        options = [(((w >> bits) + after[end][0] << bits | w & letters) << 3 | after[end][1], end) for end in range(4) if (w := weights[end][state]) is not None]
        best, end = min(options, default=(None, 0))
        ends.append(end)
        found.append(best)
    tail = letters << 3 | 7
    order = sorted({w & tail for w in found if w is not None})
    return ends, [(NEVER, 0) if w is None else (w >> bits + 3, order.index(w & tail)) for w in found]


#: (cost, rank of the letters) of what ends a conversation in each state.
CLOSING = [(k * INSERT, k) for k in ENDING]


def replay(state: int, letters: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the edits leave."""
    turns = iter(zip(roles, texts))
    for letter in letters:
        role, text = (NAMES[WANTED[state]], "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter == "R":
            role = NAMES[WANTED[state]]
        state = GOES[state][role[0]]
        yield letter, role, text


# --- from tables to pieces ---------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, dropped: nulls of role and text are one space, nothing is dropped."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.lit(1).cast("long").alias("copies"), F.lit(False).alias("dropped"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with a fault put into a quarter of them, by a checksum of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns_of(conversations).withColumn("fault", fault)
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 0, "").when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"), (F.col("fault") == 0).alias("dropped"))


def in_order(turns: DataFrame) -> DataFrame:
    """The turns with `repeats` (role and text were seen at an earlier turn), dealt by range and sorted.

    Equal rows are one with a count before anything is dealt by key. Only texts
    that occur at several turns of a conversation are joined.
    """
    one = turns.groupBy("conv_id", "turn", "role", "text", "dropped").agg(F.sum("copies").alias("copies"))
    one = one.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    first = one.where("NOT dropped").groupBy(F.col("conv_id").alias("first_conv"), F.col("digest").alias("first_digest")).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = one.join(first, one["conv_id"].eqNullSafe(first["first_conv"]) & (one["digest"] == first["first_digest"]), "left")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "dropped", F.coalesce(at > F.col("first"), F.lit(False)).alias("repeats"))
    order: list[Column] = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    return rows.repartitionByRange(*order, F.asc(F.substring("text", 1, 32))).sortWithinPartitions(*order, F.asc("text"))


KEPT = "roles array<string>, texts array<string>"
COUNTS = "blank long, duplicate long, truncated long, illegal long"
SPAN = "n_turns long, low long, high long, first_turn long, last_turn long, first_role string, last_role string"


def _copies(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(turn, role, text, kind, fault) of each turn and copy, in order."""
    for _, turn, role, text, copies, dropped, repeats in rows:
        if dropped:
            continue
        bare = text.rstrip(SPACE)
        for copy in range(copies):
            fault = "blank" if not bare else "duplicate" if repeats or copy else "truncated" if bare[-1] not in ".!?" else ""
            yield turn, role, text, (role[:1], fault in ("blank", "duplicate"), fault == "truncated"), fault


def _pieces(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    piece, size = [], 0
    for row in _copies(rows):
        if piece and (len(piece) == PIECE or size + len(row[2]) > PIECE_BYTES):
            yield piece
            piece, size = [], 0
        piece.append(row)
        size += len(row[2])
    yield piece  # perhaps empty: a conversation without turns is one


LEGAL = {"su", "ua", "au"}


def _described(conv: object, part: int, no: int, piece: list[tuple], whole: bool) -> dict:
    turns = [t for t, *_ in piece if t is not None]
    roles, kinds, faults = [p[1] for p in piece], [p[3] for p in piece], [p[4] for p in piece]
    cost, letters = whole_weight(kinds) if whole else (None, None)
    weights = None if whole else [None if w is None else format(w, "x") for row in piece_weights(kinds) for w in row]
    return {
        "conv_id": conv, "part": part, "no": no, "whole": whole, "enter": 0, "cost": cost, "letters": letters, "weights": weights, "turns": len(piece),
        "roles": roles, "texts": [p[2] for p in piece],
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])),
        "n_turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None,
    }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for rows in batches:
        yield from zip(*(c.to_pylist() for c in rows.columns))


def _records(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most 512 records or about 8 MB of texts."""
    held, size = [], 0
    for record in found:
        held.append(record)
        size += sum(map(len, record.get("texts") or ())) + len(record.get("audit") or "")
        if len(held) == 512 or size > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(schema: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def pieces_of(turns: DataFrame) -> DataFrame:
    """Pieces of conversations with their counts; `whole` ones have cost and letters, others their weights."""
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, no long, whole boolean, enter int, cost long, letters string, weights array<string>, turns int, {KEPT}, {COUNTS}, {SPAN}"
    arrow = _arrow(schema, spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found() -> Iterator[dict]:
            waiting: list[tuple] = []  # the newest piece of the newest conversation: it may be the task's last
            for nth, (conv, rows) in enumerate(groupby(_rows(batches), key=lambda r: r[0])):
                for no, piece in enumerate(_pieces(rows)):
                    if waiting:
                        seen, number, old, first = waiting
                        yield _described(seen, part, number, old, not first and number == 0 and no == 0)
                    waiting = [conv, no, piece, nth == 0]
            if waiting:
                yield _described(waiting[0], part, waiting[1], waiting[2], False)

        yield from _records(found(), arrow)

    return in_order(turns).mapInArrow(run, schema)


def _states(pieces: DataFrame) -> DataFrame:
    """conv_id, part, no, enter, leave, last, cost (at the first piece) of the pieces of conversations that are not whole.

    A conversation's pieces pass by from its last to its first; of each, four
    states and its number are kept until the first is known.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, no long, enter int, leave int, last boolean, cost long"
    arrow = _arrow(schema, pieces.sparkSession)
    rows = pieces.where("NOT whole").select("conv_id", "part", "no", "turns", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
                after, numbers, ends = CLOSING, array("q"), bytearray()
                for _, part, no, turns, weights in group:
                    to, after = backward(turns, _table(weights), after)
                    numbers.extend((part, no))
                    ends.extend(to)
                state, n = 0, len(numbers) // 2
                for k in reversed(range(n)):
                    leave = ends[4 * k + state]
                    yield {"conv_id": conv, "part": numbers[2 * k], "no": numbers[2 * k + 1], "enter": state, "leave": leave, "last": k == 0, "cost": after[0][0] if k == n - 1 else 0}
                    state = leave

        yield from _records(found(), arrow)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no")).mapInArrow(run, schema)


def _table(weights: list[str | None]) -> list[list[int | None]]:
    return [[None if x is None else int(x, 16) for x in weights[4 * e : 4 * e + 4]] for e in range(4)]


def _cut_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of pieces from their weights and states, in place of weights, leave and last."""
    for rows in batches:
        letters = []
        for turns, weights, enter, leave, last in zip(*(rows.column(c).to_pylist() for c in ("turns", "weights", "enter", "leave", "last"))):
            letters.append(letters_of(int(weights[4 * leave + enter], 16), places(turns)) + ("I" * ENDING[leave] if last else ""))
        yield rows.drop_columns(["weights", "leave", "last"]).append_column("letters", pa.array(letters, pa.string()))


def solved(turns: DataFrame) -> DataFrame:
    """All pieces with their letters; written once to the shared folder, as the joins read them twice."""
    pieces = written(pieces_of(turns), "conversations")
    states = _states(pieces).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("no").alias("n"), "enter", "leave", "last", "cost")
    cut = pieces.where("NOT whole").drop("enter", "cost", "letters")
    same = cut["conv_id"].eqNullSafe(states["c"]) & (cut["part"] == states["p"]) & (cut["no"] == states["n"])
    rest = cut.join(states, same).drop("c", "p", "n")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema if f.name not in ("weights", "leave", "last")) + ", letters string"
    return pieces.where("whole").drop("weights").unionByName(rest.mapInArrow(_cut_letters, schema))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part, no, place, edit, role, text: the repaired conversations; ordered by (part, no, place) in each."""
    pieces = solved(turns).select("conv_id", "part", "no", "enter", "letters", "roles", "texts")
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, no long, place int, edit string, role string, text string"
    arrow = _arrow(schema, pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv, part, no, place, *edit) for conv, part, no, enter, letters, roles, texts in _rows(batches) for place, edit in enumerate(replay(enter, letters, roles, texts)))
        while some := list(islice(found, 4096)):
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row)) for row in some], schema=arrow)

    return pieces.mapInArrow(run, schema)


RESULT = f"gaps long, {COUNTS}, cost long, audit string, repaired_sha256 string"


def repair_report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    done = solved(turns)
    kind = done.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {RESULT}"
    arrow = _arrow(schema, done.sparkSession)
    names = ["conv_id", "enter", "cost", "letters", *[f.split()[0] for f in f"{KEPT}, {COUNTS}, {SPAN}".split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
                out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                digest, audit, any_row, n, low, high, last_turn, last_role = hashlib.sha256(), [], False, 0, None, None, None, None
                for row in group:
                    p = dict(zip(names, row))
                    for name in out:
                        out[name] += p[name]
                    audit.append(p["letters"])
                    for _, role, text in replay(p["enter"], p["letters"], p["roles"], p["texts"]):
                        digest.update((f"\n{role}:{text}" if any_row else f"{role}:{text}").encode("utf-8", "replace"))
                        any_row = True
                    if p["low"] is not None:
                        n += p["n_turns"] - (p["first_turn"] == last_turn)
                        low, high, last_turn = p["low"] if low is None else low, p["high"], p["last_turn"]
                    if p["first_role"] is not None:
                        out["illegal"] += last_role is not None and last_role[:1] + p["first_role"][:1] not in LEGAL
                        last_role = p["last_role"]
                yield out | {"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - n, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        yield from _records(found(), arrow)

    whole = done.where("whole").select(*names).mapInArrow(run, schema)
    cut = done.where("NOT whole").select(*names, "part", "no").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").drop("part", "no").mapInArrow(run, schema)
    return whole.unionByName(cut)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))
