"""Repairs against a plain search that keeps whole strings, and against all sequences of edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from casewright.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, edits) for rows of (initial, fault)."""
    best = {0: (0, "")}

    def offer(to, state, cost, edits):
        if state not in to or (cost, edits) < to[state]:
            to[state] = cost, edits

    def insert(to):
        for _ in range(4):
            for state, (cost, edits) in list(to.items()):
                offer(to, 3 if state == 2 else 2, cost + 3, edits + "I")
        return to

    insert(best)
    for initial, fault in rows:
        after = {}
        for state, (cost, edits) in best.items():
            offer(after, state, cost + 4, edits + "D")
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for letter, froms, to in (("s", (0,), 1), ("u", (0, 1, 3), 2), ("a", (2,), 3)):
                    if state in froms and initial == letter:
                        offer(after, to, cost + more, edits + "K")
                offer(after, 3 if state == 2 else 2, cost + more + 3, edits + "R")
        best = insert(after)
    return min(best[s] for s in (0, 3) if s in best)


def all_sequences(rows, most=3):
    """The same from every sequence with at most ``most`` insertions, checked by the grammar alone."""
    found = []
    roles = {"K": None, "Ru": "u", "Ra": "a", "D": ""}
    for edits in itertools.product(roles, repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, rows, strict=True)):
            continue
        for n in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for put in itertools.product("ua", repeat=n):
                    out, audit, cost = "", "", 0
                    for k in range(len(rows) + 1):
                        for p, letter in zip(places, put, strict=True):
                            if p == k:
                                out, audit, cost = out + letter, audit + "I", cost + 3
                        if k < len(rows):
                            initial, fault = rows[k]
                            out += initial if edits[k] == "K" else roles[edits[k]]
                            audit += edits[k][0]
                            cost += {"K": 0, "R": 3, "D": 4}[edits[k][0]] + 3 * (fault == "truncated" and edits[k] != "D")
                    if re.fullmatch("(s?(ua)+)?", out):
                        found.append((cost, audit))
    return min(found)


def searched(rows):
    search, out = turn_repair.Repair(), ""
    for row in rows:
        out += search.add(*row)
    left, cost = search.end()
    return cost, out + left


def some_rows(rng, most):
    weights = rng.choice([(1, 1, 1, 0), (0, 1, 1, 0), (3, 1, 1, 1), (1, 5, 1, 0)])
    faults = rng.choice([(8, 1, 1, 1), (1, 3, 3, 3), (1, 0, 0, 4)])
    kinds = ("", "blank", "duplicate", "truncated")
    return [(rng.choices("suat", weights)[0], rng.choices(kinds, faults)[0]) for _ in range(rng.randrange(most + 1))]


def test_equals_a_search_on_whole_strings():
    rng = random.Random(1)
    for _ in range(8000):
        rows = some_rows(rng, 14)
        assert searched(rows) == cheapest(rows)


def test_equals_all_sequences():
    rng = random.Random(2)
    for _ in range(60):
        rows = some_rows(rng, 3)
        assert searched(rows) == all_sequences(rows)


@pytest.mark.parametrize("kind", range(4))
def test_memory_does_not_grow_with_the_conversation(kind):
    rng, search, most, out = random.Random(3), turn_repair.Repair(), 0, 0
    for k in range(30_000):
        row = [(rng.choice("su"), "truncated"), ("ua"[k % 2], ""), ("u", "blank"), (rng.choice("sua"), rng.choice(["", "blank", "truncated"]))][kind]
        out += len(search.add(*row))
        most = max(most, search.size() if k % 100 == 0 else 0)
    assert most < 200 and out > 29_000


def test_a_run_whose_first_edit_depends_on_its_end_is_held():
    search = turn_repair.Repair()
    rows = [("s", "")] * 2000
    out = "".join(search.add(*row) for row in rows)
    assert not out and search.size() <= 2 * len(rows) + 10
    for more in ([], [("s", "")]):
        assert searched(rows[:300] + more) == cheapest(rows[:300] + more)
    # A row that is kept resolves it.
    out += search.add("u", "") + search.add("a", "")
    assert len(out) > 1990 and search.size() < 50


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """The digest of every conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in damaged([r for r in rows if r[0] == conv])]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            last = WORD.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        turns = [r[0] for r in own if r[0] is not None]
        lines, left = [], iter(own)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit in "RI":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, turn_repair.digests(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_conversations_damaged_and_repaired(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(["Yes.", "No", "What?", f"text {rng.random()}.", "done! \n", " \t", "ÉÉ."])))
    rng.shuffle(rows)
    got = result(spark, rows)
    assert got == plain(rows)
    assert all(len({r[k] for r in got}) > 1 for k in range(1, 9))


def test_edges(spark):
    rows = [
        (None, 1, "user", "a."), (None, None, "assistant", "b."), (1, None, None, None), (1, None, "user", None), (2, 5, "", "x."), (2, 5, "", "x."),
        (3, 1, "user", "long " * 100_000 + "."), (3, 2, "assistant", "c" * 300_000), (4, None, "user", "q?"), (4, None, "assistant", "r."),
        (5, -3, "user", "q?"), (5, 2**40, "assistant", "　"),
    ]
    assert result(spark, rows) == plain(rows)
    assert result(spark, []) == []
    lost = [(k, 0, "user", "q?") for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    assert {r[1:] for r in result(spark, lost)} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    named = SCHEMA + ", step int, edit string, copy int, kind string, fault int"
    assert result(spark, [(*r, 1, "x", 2, "y", 3) for r in rows], named) == plain(rows)


def test_edits_carry_rows_and_texts(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "user", "  "), (1, 3, "assistant", "So")]
    got = turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.edit, r.role, r.new_role, r.text, r.fault) for r in got] == [
        ("I", None, "user", "", None), ("K", "assistant", "assistant", "Hi.", ""), ("K", "user", "user", "What?", ""),
        ("D", "user", None, "  ", "blank"), ("K", "assistant", "assistant", "So", "truncated"),
    ]
    assert [r.step for r in got] == list(range(5))
