from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import product

import pytest

from cartlore.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, stretch string, cost string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def cheapest(roles):
    """Least cost by trying every state sequence: a turn is merged or moves on, with empty turns in between."""
    best = float("inf")
    for choice in product(range(8), repeat=len(roles)):
        state, cost = 0, 0.0
        for role, pick in zip(roles, choice):
            to, merge = pick % 4, pick >= 4
            if merge:
                if to != state or not state:
                    cost = float("inf")
                    break
                cost += 1 if role == chat.ROLES[state] else 4
            else:
                ways = [n * 2 for n, s in reach(state) if to in chat.NEXT[s]]
                if not ways:
                    cost = float("inf")
                    break
                cost += min(ways) + (0 if role == chat.ROLES[to] else 3 if role in chat.ROLES[1:] else 1)
                state = to
        if cost < best:
            ends = [n * 2 for n, s in reach(state) if s == chat.LAST]
            best = min(best, cost + min(ends))
    return best


def reach(state, most=4):
    found, now = [], {state}
    for n in range(most):
        found += [(n, s) for s in now]
        now = {t for s in now for t in chat.NEXT[s]}
    return found


def parsed(text):
    return re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)


def legal(roles):
    state = 0
    for r in roles:
        to = chat.ROLES.index(r)
        if to not in chat.NEXT[state]:
            return False
        state = to
    return state == chat.LAST


def test_cost_is_the_least(spark):
    rng = random.Random(6)
    convs = {c: [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randrange(1, 5))] for c in range(60)}
    rows = [(c, t, r, f"text {c} {t}") for c, roles in convs.items() for t, r in enumerate(roles)]
    found = {r["conv_id"]: r for r in chat.rendered(chat.repair(table(spark, rows))).collect()}
    for c, roles in convs.items():
        assert found[c]["cost"] == cheapest(roles), roles
        turns = parsed(found[c]["text"])
        assert legal([r for r, _ in turns]), turns
        assert [x for _, t in turns for x in t.split("\n\n") if x] == [f"text {c} {t}" for t in range(len(roles))]


@pytest.mark.parametrize("stretch", [1, 3, 7])
def test_stretches_change_nothing(spark, stretch):
    rng = random.Random(9)
    rows = [(0, t, rng.choice(["system", "user", "assistant", "User ", "x", None]), f"t{t}") for t in range(60)]
    rows += [(c, t, rng.choice(["system", "user", "assistant"]), f"{c} {t}") for c in range(1, 12) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", None), (None, 1, "user", "")]
    whole, parts = (sorted(map(str, chat.repair(table(spark, rows), s).collect())) for s in (1 << 16, stretch))
    assert whole == parts


def test_actions(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"),
        (2, 0, "assistant", "a"),
        (3, 0, "user", None),
        (4, 0, "user", "x"), (4, 0, "user", "x"), (4, 1, "assistant", "y"),
    ]
    found = defaultdict(list)
    for r in sorted(chat.repair(table(spark, rows)).collect(), key=lambda r: r["place"]):
        found[r["conv_id"]].append((r["action"], r["new_role"], r["inserted_before"], r["inserted_after"], r["cost"]))
    assert [a[0] for a in found[1]] == ["keep", "merge", "keep"]
    assert found[2] == [("keep", "assistant", ["user"], [], 2)]
    assert found[3] == [("keep", "user", [], ["assistant"], 2)]
    assert [a[0] for a in found[4]] == ["keep", "merge", "keep"]
    assert chat.repair(table(spark, rows).limit(0)).count() == 0
