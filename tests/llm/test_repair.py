"""Conversation repair against exhaustive search and against a plain second version over whole tables."""

import hashlib
import zlib
from itertools import product

import pytest

from quillwork.llm import repair

SPACE = " \t\n\x0b\x0c\r"
KINDS = "conv_id long, turn long, role string, text string"


def legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (body != "" and body == "ua" * (len(body) // 2))


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, inserts):
    """(cost, letters, repaired rows) of every legal way with at most `inserts` inserts a gap: no dynamic programming."""
    faults = faults_of(rows)
    gaps = [[[]] + [list(p) for n in range(1, inserts + 1) for p in product(("user", "assistant"), repeat=n)] for _ in range(len(rows) + 1)]
    ways = []
    for (role, text), fault in zip(rows, faults):
        mine = [("D", 2, [])]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            mine += [("K", extra, [(role, text)])] + [("R", 1 + extra, [(to, text)]) for to in ("user", "assistant")]
        ways.append(mine)
    for put in product(*gaps):
        for edits in product(*ways):
            cost, letters, out = 0, "", []
            for k in range(len(rows) + 1):
                cost += 5 * len(put[k])
                letters += "I" * len(put[k])
                out += [(role, "") for role in put[k]]
                if k < len(rows):
                    letters += edits[k][0]
                    cost += edits[k][1]
                    out += edits[k][2]
            if all(role for role, _ in out) and legal("".join(role[0] for role, _ in out)):
                yield cost, letters, out


def plain_repair(rows):
    """Forward dynamic programming on (cost, letters, repaired rows), in tuples; states by name."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, letters, out) in list(best.items()):
                for c in "ua":
                    if (state, c) in step:
                        new = (cost + 5, letters + "I", out + [(names[c], "")])
                        to = step[state, c]
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    best = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults_of(rows)):
        new = {}
        for state, (cost, letters, out) in inserted(best).items():
            edits = [(state, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    edits.append((step[state, role[:1]], extra, "K", [(role, text)]))
                edits += [(step[state, c], extra + 1, "R", [(names[c], text)]) for c in "ua" if (state, c) in step]
            for to, c, letter, kept in edits:
                made = (cost + c, letters + letter, out + kept)
                if to not in new or made[:2] < new[to][:2]:
                    new[to] = made
        best = new
    return min((x for state, x in inserted(best).items() if state in ("", "a")), key=lambda x: x[:2])


def damaged(table):
    """{conv_id: [(turn, role, text)]} after damage."""
    found = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return found


def expected(found):
    out = {}
    for conv, rows in found.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        said = [(role, text) for _, role, text in rows]
        faults = faults_of(said)
        cost, letters, left = plain_repair(said)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, digest)
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("roles", ["", "u", "s", "us", "ua", "aa", "uu", "su", "sau", "asu", "xua", "auu", "uxa"])
def test_exhaustive(roles):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    for texts in product(("One.", "open", " "), repeat=len(roles)):
        rows = [(names[c], t) for c, t in zip(roles, texts)]
        kinds = [(r[:1], f in ("blank", "duplicate"), f == "truncated") for (r, _), f in zip(rows, faults_of(rows))]
        cost, letters = repair.whole_weight(kinds)
        best = min(all_edits(rows, 2 if len(rows) < 3 else 1), key=lambda x: x[:2])
        assert (cost, letters) == best[:2] == plain_repair(rows)[:2]
        assert [(r, t) for _, r, t in repair.replay(0, letters, *map(list, zip(*rows)))] == best[2] if rows else letters == ""


def test_cheap_inserts_in_pieces(monkeypatch):
    """With inserts that pay, pieces joined by rank give what one piece gives."""
    monkeypatch.setattr(repair, "INSERT", 1)
    monkeypatch.setattr(repair, "CLOSING", [(k, k) for k in repair.ENDING])
    repair.moves.cache_clear()
    try:
        for roles in product("usax", repeat=5):
            kinds = [(c, k % 4 == 3, k % 3 == 2) for k, c in enumerate(roles)]
            for cut in (1, 2, 3):
                parts = [kinds[a : a + cut] for a in range(0, 5, cut)]
                after, ends = repair.CLOSING, []
                for part in reversed(parts):
                    to, after = repair.backward(len(part), repair.piece_weights(part), after)
                    ends.insert(0, to)
                state, letters = 0, ""
                for part, to in zip(parts, ends):
                    letters += repair.letters_of(repair.piece_weights(part)[to[state]][state], repair.places(len(part)))
                    state = to[state]
                letters += "I" * repair.ENDING[state]
                assert (after[0][0], letters) == repair.whole_weight(kinds)
    finally:
        repair.moves.cache_clear()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op13_conversation_repair(spark, path)) == expected(damaged(rows))


EDGES = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "No."), (1, 1, "assistant", "No."),
    (2, None, None, None), (2, None, "user", "A?"), (2, 7, "assistant", "B!"),
    (None, 1, "system", "S."), (None, 2, "user", "U."), (None, 3, "assistant", "end　"),
    (3, 5, "", "x."), (3, 2, "üser", "é."), (4, 9, "user", " \t\n\x0b\x0c\r"), (5, 1, "user", " "), (5, -3, "user", "w" * 100_000 + "."),
]


def test_edges_and_pieces(spark, monkeypatch, tmp_path):
    """Nulls, ties, repeats, clashing names; a conversation over several pieces and tasks."""
    long = [(9, k, ("user", "assistant", "assistant")[k % 3], f"turn {k % 50}" + "." * (k % 2)) for k in range(700)]
    rows = EDGES + long
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{KINDS}, part int, letters string").repartition(7)
    assert got(repair.repair_report(repair.damaged(df))) == expected(damaged(rows))
    undamaged = {}
    for conv, turn, role, text in rows:
        undamaged.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = expected(undamaged)
    assert got(repair.repair_report(repair.turns_of(df))) == want
    parts = {}
    for r in sorted(repair.repaired_turns(repair.turns_of(df)).collect(), key=lambda r: (r.part, r.no, r.place)):
        parts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(p).encode()).hexdigest() for c, p in parts.items()} == {c: w[-1] for c, w in want.items() if w[-1] != hashlib.sha256().hexdigest()}


def test_nothing_left_and_empty(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Gone.")], KINDS)
    assert got(repair.repair_report(repair.damaged(df))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repair.repair_report(repair.damaged(df.limit(0))).count() == 0
