"""Repairs against the best of all edits, independence of chunks and passes, damage, awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from cartlore.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string, place string, chunk string, fault string, cost string"
SPACES = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        body = text.strip(SPACES)
        if not body:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def best_audit(rows):
    """(cost, audit) by trying every edit of every row, with up to three insertions in a row; only then checked for legality."""
    kinds = tuple((role[:1], fault) for (role, _), fault in zip(rows, faults(rows)))

    @cache
    def rest(i: int, initials: str, inserted: int):
        # of the initials so far only the last one counts, and whether there is any
        found = []
        if i == len(kinds):
            if re.fullmatch("(s?(ua)+)?", initials) or initials == "a":
                found.append((0, ""))
        else:
            role, fault = kinds[i]
            cost, audit = rest(i + 1, initials, 0)
            found.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for letter, to, price in (("K", role, 0), ("R", "u", 3), ("R", "a", 3)):
                    if may_follow(initials, to):
                        cost, audit = rest(i + 1, to, 0)
                        found.append((cost + price + more, letter + audit))
        if inserted < 3:
            for to in "ua":
                if may_follow(initials, to):
                    cost, audit = rest(i, to, inserted + 1)
                    found.append((cost + 3, "I" + audit))
        return min(found, default=(10**9, ""))

    return rest(0, "", 0)


def may_follow(last, to):
    return to != "" and last + to in ("s", "u", "su", "ua", "au")


def spelled(rows, audit):
    lines, state, i = [], "", 0
    for letter in audit:
        turned = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[turned]
        if letter == "I":
            lines.append(f"{name}:")
            state = turned
            continue
        role, text = rows[i]
        i += 1
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = role[0]
        elif letter == "R":
            lines.append(f"{name}:{text}")
            state = turned
    assert i == len(rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(conversations):
    """By conversation; rows in order of turn (null first), role and text, where the tests leave no other ties."""
    found = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = {t for t, _, _ in rows if t is not None}
        plain = [(role, text) for _, role, text in rows]
        kinds = faults(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit = best_audit(plain)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, spelled(plain, audit))
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(spark, conversations, ids=None, **more):
    rows = [(c, t, r, x) for c, own in conversations.items() for t, r, x in own]
    df = table(spark, rows)
    result = structure.stored(structure.repair_structure(df, **more), "test")
    assert result.count() == len(rows)
    out = structure.summaries(result, df if ids is None else ids)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}


def some_conversations(seed, n, most):
    draw = random.Random(seed)
    found = {}
    for conv in range(n):
        rows = []
        for t in range(draw.randint(1, most)):
            role = draw.choice(("user", "assistant", "user", "assistant", "system", "tool"))
            rows.append((t, role, draw.choice((f"Text {t}.", f"Cut {t}", "Same!", "", "Other?  \n"))))
        found[conv] = rows
    return found


@pytest.mark.parametrize(("chunk", "passes"), [(4096, 4), (1, 4), (2, 0), (3, 1)])
def test_cheapest_repair(spark, chunk, passes):
    conversations = some_conversations(chunk, 60, 7)
    assert repaired(spark, conversations, chunk=chunk, passes=passes) == expected(conversations)


@pytest.mark.parametrize("kind", ["user", "tool", "mixed"])
def test_long_conversations_that_never_converge(spark, kind):
    """Turns of one role keep two cost vectors apart for ever, so fix-up passes alone would go through all chunks."""
    rows = [(t, kind if kind != "mixed" else ("user", "assistant", "system")[t * t % 7 % 3], f"Text {t}.") for t in range(90)]
    conversations = {1: rows, 2: rows[:17], 3: rows[:1]}
    one = repaired(spark, conversations)
    assert repaired(spark, conversations, chunk=5, passes=2) == one
    assert repaired(spark, conversations, chunk=5, passes=0) == one
    assert one == expected(conversations)


def test_vectors():
    """Vectors are closed under all kinds of rows, and a fix-up gives what a whole rerun gives."""
    known = structure.vectors()
    assert len(known) == len(set(known)) == 30
    draw = random.Random(1)
    for _ in range(300):
        codes = "".join(draw.choices(structure.SOUND + structure.CUT + structure.GONE, k=draw.randint(1, 9)))
        end, former = draw.choice(known), draw.choice(known)
        assert structure.fixed_up(codes, end, former, structure.backward(codes, former)) == structure.backward(codes, end)


def test_awkward_rows(spark):
    conversations = {
        1: [(None, "user", "First."), (3, "assistant", "Last."), (9, "user", "x" * 300_000 + ".")],
        None: [(None, "user", "a."), (None, "user", "b.")],
        3: [(5, "", "No role."), (5, "u", "Short name.")],
        4: [(1, "user", "Twice."), (1, "user", "Twice."), (2, "assistant", " . ")],
        5: [(1, "system", "Alone.")],
        6: [(2**40, "user", "Far."), (0, "assistant", "é\U0001f389?\x0b\r")],
    }
    assert repaired(spark, conversations) == expected(conversations)
    nulls = {7: [(1, None, "Text."), (2, "user", None)]}
    assert repaired(spark, nulls, chunk=1) == expected({7: [(1, " ", "Text."), (2, "user", " ")]})


def test_no_rows(spark):
    ids = table(spark, [(1, 1, "user", "x"), (None, 1, "user", "x"), (1, 2, "user", "x")])
    empty = hashlib.sha256().hexdigest()
    none = structure.stored(structure.repair_structure(ids.filter("false")), "test")
    out = {tuple(r[c] for c in ["conv_id", *COLUMNS]) for r in structure.summaries(none, ids).collect()}
    assert out == {(i, 0, 0, 0, 0, 0, 0, "", empty) for i in (1, None)}
    assert structure.summaries(none, ids.filter("false")).collect() == []


def test_damage(spark):
    rows = [(c, t, role, f"Text. {t}! Why?") for c in range(20) for t in (*range(8), None) for role in ("assistant", None)]
    expected_rows = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else " " if role is None else role
            expected_rows += [(c, t, role, text)] * (2 if kind == 3 else 1)
    found = [tuple(r) for r in structure.damaged(table(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(expected_rows, key=str)
    assert {zlib.crc32(f"{c}:{t}".encode()) % 20 for c in range(20) for t in range(8)} >= {0, 1, 2, 3, 4}
