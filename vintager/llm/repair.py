r"""Conversation structure repair by aligning turns to the alternating grammar.

A conversation's role initials should read ``(s?(ua)+)?``. Rows can be kept (cost 0), given another
role (3) or deleted (4), and empty turns inserted (3); blank and repeated rows have to be deleted, and
a truncated row that stays adds 3. The grammar's string of every feasible length is a Wagner-Fischer
target. The strings without ``s`` are suffixes of one another, so one table whose column k stands for
the last k letters aligns the rows to all lengths; a second one puts ``s`` before them. A first-fit
repair gives the incumbent cost C, and Ukkonen's bound leaves of each row only the columns that C can
reach: at most C/4 more rows than letters or C/3 more letters than rows. Every length whose cost is
the lowest is traced back, taking at each cell the ASCII-least edit, and the audits are compared.

The table has about 0.6 n C cells. Conversations of more than ``LONG`` rows are therefore aligned with
all lengths of equal parity folded into one column (whether u or a is expected), which takes time
linear in the rows and gives the same costs and audits.

Rows are taken in the order of (turn, role, text), a null turn first. Defined cases: a null role or
text is one space; a role that is neither s, u nor a has to be renamed or deleted; repeated rows are
duplicates; rows without conv_id are one conversation; a conversation without rows has zeros, an
empty audit and nothing repaired; an empty table gives no rows; other columns, whatever their names,
are left out. A repaired conversation is one output value, so it has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
# A row for the aligner: its initial (0 for any other) and two marks.
INITIALS = {"s": 1, "u": 2, "a": 3}
GONE, CUT = 4, 8
LONG = 1024
REMEMBERED_ROWS, REMEMBERED = 64, 1 << 15
NEVER = 1 << 29
AUDITED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired array<struct<role:string,text:string>>"
)
FLUSH_CHARS = 4 << 20


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after a damage that conv_id and turn decide; present is false for dropped ones."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    space = F.lit(" ")
    key = F.concat(F.coalesce(conv, space), F.lit(":"), F.coalesce(turn, space))
    fate = F.crc32(key.cast("binary")) % 20
    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        fate.alias("fate"),
    )
    text = F.col("text")
    return slim.select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        (F.col("fate") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def first_fit(rows: bytes) -> int:
    """The cost of renaming whatever is not the next letter; no repair costs more than it has to."""
    cost, expected = 0, 2
    for row in rows:
        if row & GONE:
            cost += DELETE
            continue
        cost += (row & 3 != expected) * RENAME + bool(row & CUT) * UNFINISHED
        expected = 5 - expected
    return cost + (expected == 3) * INSERT


def _aligned(rows: bytes) -> tuple[int, str]:
    """The lowest cost over all target lengths and its ASCII-least audit."""
    n, most = len(rows), first_fit(rows)
    low, high = most // DELETE + 1, most // INSERT + 1
    width = low + high + 1
    # Column c of row i stands for k = n - i + c - low letters.
    surplus = np.arange(-low, high + 1)
    steps = INSERT * surplus
    plain = np.full((n + 1, width + 1), NEVER, np.int64)
    led = np.full((n + 1, width + 1), NEVER, np.int64)
    plain[n, :width] = np.where(surplus >= 0, steps, NEVER)
    for i in range(n - 1, -1, -1):
        row, letters = rows[i], n - i + surplus
        after = plain[i + 1]
        best = after[1:] + DELETE
        unfinished = UNFINISHED if row & CUT else 0
        if not row & GONE:
            wanted = 2 + (letters & 1)
            cost = np.where(wanted == row & 3, 0, RENAME) + unfinished
            best = np.minimum(best, np.where(letters > 0, after[:-1] + cost, NEVER))
        best[letters < 0] = NEVER
        plain[i, :width] = np.minimum(np.minimum.accumulate(best - steps) + steps, NEVER)
        led[i, :width] = led[i + 1, 1:] + DELETE
        if row & 7 == INITIALS["s"]:
            led[i, :width] = np.minimum(led[i, :width], after[1:] + unfinished)

    letters = n + surplus
    even = letters % 2 == 0
    ends = [(False, k) for k in letters[even & (letters >= 0)].tolist()]
    ends += [(True, k) for k in letters[even & (letters >= 2)].tolist()]

    def at(s: bool, i: int, k: int) -> int:
        c = k - (n - i) + low
        return int((led if s else plain)[i, c]) if 0 <= c < width else NEVER

    cost = min(at(s, 0, k) for s, k in ends)
    return cost, min(_traced(rows, at, s, k) for s, k in ends if at(s, 0, k) == cost)


def _traced(rows: bytes, at, s: bool, k: int) -> str:
    """The ASCII-least of the cheapest audits for one target length."""
    i, n, audit = 0, len(rows), []
    while i < n or k or s:
        left = at(s, i, k)
        row = rows[i] if i < n else GONE
        unfinished = UNFINISHED if row & CUT else 0
        if i < n and at(s, i + 1, k) + DELETE == left:
            audit.append("D")
            i += 1
        elif not s and k and at(False, i, k - 1) + INSERT == left:
            audit.append("I")
            k -= 1
        elif s:
            audit.append("K")
            i, s = i + 1, False
        else:
            keeps = row & 3 == 2 + (k & 1) and at(False, i + 1, k - 1) + unfinished == left
            audit.append("K" if keeps else "R")
            i, k = i + 1, k - 1
    return "".join(audit)


def _folded(rows: bytes) -> tuple[int, str]:
    """As _aligned, with one column for all lengths: what is expected next decides.

    Column 0: nothing is written yet; 1: s is, so a pair has to follow; 2: u or the end; 3: a.
    """
    n = len(rows)
    left = [(0, NEVER, 0, NEVER)] * (n + 1)

    def inserted(b0: int, b1: int, b2: int, b3: int) -> tuple[int, int, int, int]:
        a = min(b3, b2 + INSERT)
        return min(b0, a + INSERT), min(b1, a + INSERT), min(b2, b3 + INSERT), a

    left[n] = inserted(0, NEVER, 0, NEVER)
    for i in range(n - 1, -1, -1):
        row, (v0, v1, v2, v3) = rows[i], left[i + 1]
        b = [v + DELETE for v in (v0, v1, v2, v3)]
        if not row & GONE:
            unfinished = UNFINISHED if row & CUT else 0
            u = v3 + unfinished + (0 if row & 3 == 2 else RENAME)
            b = [min(b[0], u), min(b[1], u), min(b[2], u),
                 min(b[3], v2 + unfinished + (0 if row & 3 == 3 else RENAME))]
            if row & 3 == 1:
                b[0] = min(b[0], v1 + unfinished)
        left[i] = inserted(*b)
    i, state, audit = 0, 0, []
    while i < n or left[i][state]:
        cost = left[i][state]
        row = rows[i] if i < n else GONE
        unfinished = UNFINISHED if row & CUT else 0
        onward = 2 if state == 3 else 3
        if i < n and left[i + 1][state] + DELETE == cost:
            audit.append("D")
            i += 1
        elif left[i][onward] + INSERT == cost:
            audit.append("I")
            state = onward
        elif state == 0 and row & 7 == 1 and left[i + 1][1] + unfinished == cost:
            audit.append("K")
            i, state = i + 1, 1
        else:
            kept = row & 3 == 5 - onward and left[i + 1][onward] + unfinished == cost
            audit.append("K" if kept else "R")
            i, state = i + 1, onward
    return left[0][0], "".join(audit)


_remembered = lru_cache(REMEMBERED)(_aligned)


def align(rows: bytes) -> tuple[int, str]:
    """Lowest cost and audit of the rows of a conversation, each coded in a byte."""
    if len(rows) > LONG:
        return _folded(rows)
    return _remembered(rows) if len(rows) <= REMEMBERED_ROWS else _aligned(rows)


def applied(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) turns that an audit leaves of (role, text) turns."""
    out, rest = [], iter(turns)
    letters = sum(edit != "D" for edit in audit)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if letters & 1 else "u"]
        out.append((role, text))
        letters -= 1
    return out


def judged(turns: list[tuple[str, str]]) -> tuple[int, int, int, int, bytes]:
    """Blank, repeated, truncated rows, illegal neighbours, and the rows as the aligner takes them."""
    blank = repeated = unfinished = illegal = 0
    seen: set[tuple[str, str]] = set()
    codes = bytearray()
    before = None
    for turn in turns:
        role, text = turn
        code = INITIALS.get(role[:1], 0)
        said = text.rstrip(BLANK)
        if not said:
            blank, code = blank + 1, code | GONE
        elif turn in seen:
            repeated, code = repeated + 1, code | GONE
        elif said[-1] not in ".!?":
            unfinished, code = unfinished + 1, code | CUT
        seen.add(turn)
        codes.append(code)
        illegal += before is not None and before + role[:1] not in LEGAL
        before = role[:1]
    return blank, repeated, unfinished, illegal, bytes(codes)


def audited(rows: DataFrame, present: str | None = None) -> DataFrame:
    """Faults, the cheapest repair's audit and the repaired turns per conv_id.

    Rows whose column ``present`` is false only keep their conv_id in the result.
    """

    def result(conv: int | None, held: list[tuple]) -> tuple:
        turns = [(role, text) for _, role, text in held]
        numbers = {turn for turn, _, _ in held if turn is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        *faults, codes = judged(turns)
        cost, audit = align(codes)
        return (conv, gaps, *faults, cost, audit, applied(turns, audit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [
            pa.string(),
            pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
        ]
        names = [x.split()[0] for x in AUDITED.split(", ")]
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        held: list[tuple] = []
        conv, begun, chars = None, False, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for key, turn, role, text, counts in zip(*columns, strict=True):
                if begun and key != conv:
                    out.append(result(conv, held))
                    held = []
                    if chars > FLUSH_CHARS:
                        yield flushed()
                        chars = 0
                conv, begun = key, True
                chars += 100
                if counts:
                    held.append((turn, role, text))
                    chars += len(text)
        if begun:
            out.append(result(conv, held))
            yield flushed()

    space = F.lit(" ")
    there = F.col(present) if present else F.lit(True)
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        there.cast("boolean").alias("present"),
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, AUDITED)


def digested(rows: DataFrame) -> DataFrame:
    """Audited rows with a digest in place of the repaired turns."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return rows.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")
