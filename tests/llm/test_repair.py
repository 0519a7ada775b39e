"""op12 against every edit script by brute force, the damage by hand, awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from vintager.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) over all edit scripts; a row is (initial, must go, truncated)."""

    @lru_cache(None)
    def best(i: int, written: str, inserted: int) -> tuple[int, str]:
        # What is written matters only by its start and its last letter.
        options = [(0, "")] if i == len(rows) and written in ("", "a") else []

        def option(cost: int, edit: str, i: int, letter: str, inserted: int = 0) -> None:
            if letter and letter in {"": "su", "s": "u", "u": "a", "a": "u"}[written]:
                rest = best(i, letter, inserted)
                options.append((cost + rest[0], edit + rest[1]))

        if inserted < 2:
            for letter in "ua":
                option(3, "I", i, letter, inserted + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            after = best(i + 1, written, 0)
            options.append((4 + after[0], "D" + after[1]))
            if not gone:
                option(3 * cut, "K", i + 1, initial)
                for letter in "ua":
                    option(3 + 3 * cut, "R", i + 1, letter)
        return min(options, default=(10**6, "Z"))

    return best(0, "", 0)


def plain(turns):
    """The contract's row for one conversation's rows after damage, in order."""
    space = " \t\n\x0b\x0c\r"
    rows, faults, seen = [], [0, 0, 0], []
    for _, role, text in turns:
        said = text.strip(space)
        kind = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
        if kind is not None:
            faults[kind] += 1
        seen.append((role, text))
        rows.append((role[:1], kind in (0, 1), kind == 2))
    marks = [r[0] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(marks, marks[1:]))
    cost, audit = cheapest(rows)
    written, left = [], list(turns)
    for edit in audit:
        if edit == "I":
            written.append([None, ""])
            continue
        _, role, text = left.pop(0)
        if edit != "D":
            written.append([role if edit == "K" else None, text])
    for k, line in enumerate(reversed(written)):
        line[0] = line[0] or ("user" if k % 2 else "assistant")
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    body = "\n".join(f"{role}:{text}" for role, text in written)
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def broken(rows):
    """The damage by conv_id and turn, row by row."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(x for x in text if x not in ".!?")
        role = "user" if fate == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    order = lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())
    return {conv: sorted(own, key=order) for conv, own in out.items()}


def talk(seed: int, conversations: int, longest: int):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "use", "Assistant"]
    texts = ["Yes.", "No!", "Why?  ", "well", "", " \t", None, "same.", "ünï. \n", "a.b", "?"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"{turn} {rng.random()}."
            at = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 0, 1, 5])
            role = rng.choice(roles) if rng.random() < 0.4 else roles[turn % 2]
            rows += [(conv, at, role, text)] * rng.choice([1, 1, 1, 1, 2])
    # A conversation that loses its only row.
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "Gone."), (None, 1, "user", "Hi."), (None, None, None, None), (-7, None, "user", "So.")]


@pytest.mark.parametrize("crowd", [False, True])
def test_damaged_and_repaired(spark, crowd):
    rows = talk(1, 150, 11)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    if crowd:
        names = ("present", "fate", "copy", "gaps", "cost", "audit", "repaired")
        turns = turns.withColumns({n: F.lit("mine") for n in names})
    got = repair.digested(repair.audited(repair.damaged(turns), "present")).collect()
    expected = {conv: plain(own) for conv, own in broken(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in got} == expected and len(got) == len(expected)
    assert any(not own for own in broken(rows).values())


def test_undamaged_conversations(spark):
    """The operator itself, without damage: rows keep their roles and texts."""
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."),
        (2, 0, "assistant", "Hello."), (2, 1, "user", "Hi."),
        (3, 0, "system", "Only this."),
    ]
    got = {r.conv_id: r for r in repair.audited(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].cost, got[1].audit, len(got[1].repaired)) == (0, "KKK", 3)
    assert (got[2].cost, got[2].audit) == (6, "IKKI")
    assert [tuple(t) for t in got[2].repaired] == [
        ("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "")
    ]
    assert (got[3].cost, got[3].audit, got[3].repaired) == (4, "D", [])
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audited(empty).isEmpty() and repair.digested(repair.audited(repair.damaged(empty), "present")).isEmpty()


def coded(rows):
    return bytes(
        repair.INITIALS.get(x, 0) | repair.GONE * gone | repair.CUT * (cut and not gone)
        for x, gone, cut in rows
    )


def some_rows(rng, n):
    bad = rng.random()
    return [(rng.choice("suauaxua"), rng.random() < 0.3 * bad, rng.random() < 0.4 * bad) for _ in range(n)]


def test_alignment_is_cheapest_and_least():
    rng = random.Random(4)
    for _ in range(1500):
        rows = [(x, g, c and not g) for x, g, c in some_rows(rng, rng.randrange(10))]
        expected = cheapest(rows)
        assert repair._aligned(coded(rows)) == expected == repair._folded(coded(rows))
        assert repair.first_fit(coded(rows)) >= expected[0]


@pytest.mark.parametrize("n", [65, 300, 1024])
def test_long_conversations_fold(n):
    """Tables by length and folded columns agree where brute force is too slow."""
    rng = random.Random(n)
    for rows in (some_rows(rng, n), [("u", False, False)] * n, [("s", False, False)] * n):
        assert repair._aligned(coded(rows)) == repair._folded(coded(rows))


def test_very_long_conversation(spark):
    """More rows than a table by length is made for; every fifth is spoken by nobody known."""
    n = 20_000
    rows = [(5, i, ("user", "assistant", "user", "assistant", "tool")[i % 5], f"{i}.") for i in range(n)]
    (row,) = repair.audited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row.illegal == 2 * (n // 5) - 1 and row.cost <= 4 * (n // 5)
    marks = "".join(t.role[0] for t in row.repaired)
    assert marks == "ua" * (len(marks) // 2)
