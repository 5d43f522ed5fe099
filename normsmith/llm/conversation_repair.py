"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows, ordered by turn (nulls first; equal turns by role, then
text), are edited so that the role initials read ``(s?(ua)+)?``.  Keeping a row
costs 0, changing its role to user or assistant 1, deleting it 2, inserting an
empty user or assistant row 5.  Rows without visible text (blank) and rows
whose role and text came earlier (duplicate) must go; rows that do not end in
``.``, ``!`` or ``?`` (truncated) cost 5 more unless deleted.  Among the
cheapest edits the one whose audit, the initials D, I, K, R of the edits in
order, is least in ASCII order is taken.

The roles so far are one of four states: nothing, system, user, assistant.  A
run of rows has a forward vector (cost of reaching each state from the start)
and a backward vector (cost of finishing from each state).  The two meet in
the middle; the states with the least sum are the optimal crossings.  The left
half is solved first with all optimal crossings open: its least audit picks
the crossing (two optimal left halves never are prefixes of one another, as
each row gives one letter other than I and equal letters mean equal cost).
Then the right half starts from that crossing.  Memory is linear in the rows
of the audit, time n log n.

Long conversations are cut into segments of at most ``SEGMENT`` rows, so that
no task holds a conversation:

1. Rows get their place by one range shuffle (``ranks.sorted_rows``).
2. Each segment gives its 4 x 4 cost matrix.
3. A conversation's matrices, 16 numbers a segment, are folded from the end:
   the backward vector at every segment border.
4. Each segment is solved for each state that it may start in.
5. A fold from the start picks the state that each segment does start in.
6. Audits become edits of rows, joined back to the texts.

Only the digest of a conversation (``digests``) is sequential by definition:
one task reads its lines in order, as a stream.

Defined cases: null roles and texts are one space; a null conversation id is a
conversation of its own and comes back as null; equal rows are duplicates; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import partitions_of, sorted_rows
from .common import groups, rid, small_batches, stage, unrid

# Rows of a segment: 2 ** SEGMENT_BITS.
SEGMENT_BITS = 14
WS = " \t\n\x0b\x0c\r"

# States: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
INSERTED = (USER, USER, ASSISTANT, USER)  # state after an insertion
# Initials s, u, a and others; kinds: initial * 2 + truncated, or DELETE.
INITIALS = "sua"
DELETE = 8
# Faults, the first of a row counts.
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
# Cost and letters of what is inserted behind the last row, by state.
END = ((0, ""), (10, "II"), (5, "I"), (0, ""))


def after_keep(state: int, initial: int) -> int | None:
    """State after a kept row, None where its role may not stand."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def row_edits() -> list[list[dict[int, tuple[int, str]]]]:
    """[kind][state] -> {state after: (cost, letters)}: the cheapest, then
    ASCII-least, edits that use up one row, with insertions before it."""
    out = []
    for kind in range(9):
        truncated = 5 * (kind % 2) if kind != DELETE else 0
        table = []
        for start in range(4):
            best: dict[int, tuple[int, str]] = {}
            state, cost, letters = start, 0, ""
            for _ in range(3):
                options = [(state, 2, "D")]
                if kind != DELETE:
                    kept = after_keep(state, kind // 2)
                    options += [(kept, truncated, "K")] if kept is not None else []
                    options += [(INSERTED[state], 1 + truncated, "R")]
                for to, c, letter in options:
                    best[to] = min(best.get(to, (FAR, "")), (cost + c, letters + letter))
                state, cost, letters = INSERTED[state], cost + 5, letters + "I"
            table.append(best)
        out.append(table)
    return out


EDITS = row_edits()


def forward(kinds: bytes, start: int) -> list[int]:
    """Least cost of each state behind the rows, from ``start``."""
    v = [FAR] * 4
    v[start] = 0
    for kind in kinds:
        new = [FAR] * 4
        for state, edits in enumerate(EDITS[kind]):
            if v[state] < FAR:
                for to, (c, _) in edits.items():
                    new[to] = min(new[to], v[state] + c)
        v = new
    return v


def backward(kinds: bytes, rest: list[int]) -> list[int]:
    """Least cost of finishing from each state before the rows, when it costs
    ``rest`` from each state behind them."""
    v = list(rest)
    for kind in reversed(kinds):
        v = [min([FAR, *(c + v[to] for to, (c, _) in edits.items())]) for edits in EDITS[kind]]
    return v


def solve(kinds: bytes, start: int, rest: list[int]) -> tuple[str, int]:
    """The audit of the cheapest, then ASCII-least, edits of the rows, and
    the state behind them."""
    if len(kinds) == 1:
        (_, letters), to = min(((c + rest[to], letters), to) for to, (c, letters) in EDITS[kinds[0]][start].items())
        return letters, to
    left, right = kinds[: len(kinds) // 2], kinds[len(kinds) // 2 :]
    ahead, back = forward(left, start), backward(right, rest)
    least = min(a + b for a, b in zip(ahead, back))
    crossings = [b if a + b == least else FAR for a, b in zip(ahead, back)]
    audit, state = solve(left, start, crossings)
    more, state_after = solve(right, state, rest)
    return audit + more, state_after


@lru_cache(maxsize=1 << 16)
def short_solve(kinds: bytes, start: int, rest: tuple[int, ...]) -> tuple[str, int]:
    return solve(kinds, start, list(rest))


@lru_cache(maxsize=1 << 16)
def short_matrix(kinds: bytes) -> list[int]:
    return [c for start in range(4) for c in forward(kinds, start)]


def apply_audit(initials: list[int], start: int, audit: str) -> list[tuple[list[str], str | None, bool, list[str]]]:
    """Per row: roles inserted before it, its new role (None: its own),
    whether it stays, and (last row) roles inserted behind it."""
    names = {USER: "user", ASSISTANT: "assistant"}
    out: list = []
    state, before = start, []
    for letter in audit:
        if letter == "I":
            state = INSERTED[state]
            before.append(names[state])
            continue
        role = None
        if letter == "K":
            state = after_keep(state, initials[len(out)])
        elif letter == "R":
            state = INSERTED[state]
            role = names[state]
        out.append((before, role, letter != "D", []))
        before = []
    if before:
        out[-1][3].extend(before)
    return out


# ------------------------------------------------------------------- faults
def ordered_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, __at): all rows in order, staged."""
    small_batches(conversations.sparkSession)
    space = F.lit(" ")
    rows = conversations.select(
        rid(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    return sorted_rows(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text", "tie"]).drop("tie")


def coded_rows(rows: DataFrame) -> DataFrame:
    """(conv, __at, code): code = 4 * initial + fault."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seen = F.rtrim("text", F.lit(WS))
    last = F.substring(seen, -1, 1)
    rows = rows.select(
        "conv", "__at", same.alias("same"), F.substring("role", 1, 1).alias("initial"),
        F.when(seen == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE).alias("own"),
    )
    rows = stage(rows, "faults")
    first = rows.groupBy("conv", "same").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("__at") > F.col("first"), DUPLICATE).otherwise(F.col("own"))
    initial = F.when(F.col("initial") == "", 3)
    for k, c in enumerate(INITIALS):
        initial = initial.when(F.col("initial") == c, k)
    return rows.join(first.drop("n"), ["conv", "same"], "left").select(
        "conv", "__at", (initial.otherwise(3) * 4 + fault).alias("code")
    )


def segments_of(codes: DataFrame) -> DataFrame:
    """(conv, seg, first_at, codes): the codes of each segment in order."""
    listed = F.sort_array(F.collect_list(F.struct("__at", F.col("code").cast("int").alias("code"))))
    out = codes.groupBy("conv", F.shiftright("__at", SEGMENT_BITS).alias("seg")).agg(listed.alias("l"))
    return stage(out.select("conv", "seg", F.col("l")[0]["__at"].alias("first_at"),
                            F.transform("l", lambda x: x["code"]).alias("codes")), "segments")


def kinds_of(codes: list[int]) -> bytes:
    return bytes(DELETE if c & 3 >= BLANK else (c >> 2) * 2 + (c & 3) for c in codes)


# ----------------------------------------------------------- Spark's passes
def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in b.to_pylist():
            at = [c >> 2 for c in row["codes"]]
            kinds = kinds_of(row["codes"])
            costs = short_matrix(kinds) if len(kinds) <= 16 else short_matrix.__wrapped__(kinds)
            illegal = sum(pair not in LEGAL for pair in zip(at, at[1:]))
            out.append({"conv": row["conv"], "seg": row["seg"], "costs": costs, "illegal": illegal, "head": at[0], "last": at[-1]})
        if out:
            yield pa.RecordBatch.from_pylist(out, MATRICES)


MATRICES = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64())), ("illegal", pa.int64()),
                      ("head", pa.int32()), ("last", pa.int32())])
MATRICES_SQL = "conv long, seg long, costs array<long>, illegal long, head int, last int"
BORDERS = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("rest", pa.list_(pa.int64())), ("is_first", pa.bool_()),
                     ("is_last", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])
BORDERS_SQL = "conv long, seg long, rest array<long>, is_first boolean, is_last boolean, cost long, illegal long"


def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward vectors behind every segment; a conversation's cost and its
    illegal pairs stand in the row of its first segment."""
    for t, at in groups(batches, ["conv"]):
        rows, out = t.to_pylist(), []
        for lo, hi in zip(at[:-1], at[1:]):
            rest = [c for c, _ in END]
            illegal = 0
            for k in range(hi - 1, lo - 1, -1):
                r = rows[k]
                out.append({"conv": r["conv"], "seg": r["seg"], "rest": rest, "is_first": k == lo, "is_last": k == hi - 1})
                rest = [min([FAR, *(r["costs"][4 * p + q] + rest[q] for q in range(4))]) for p in range(4)]
                illegal += r["illegal"] + (k > lo and (rows[k - 1]["last"], r["head"]) not in LEGAL)
            out[-1] |= {"cost": rest[NOTHING], "illegal": illegal}
        yield pa.RecordBatch.from_pylist(out, BORDERS)


SOLVED = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("audit", pa.string())])
SOLVED_SQL = "conv long, seg long, start int, end int, audit string"


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment from each state that it may start in."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            kinds = kinds_of(row["codes"])
            for start in (NOTHING,) if row["is_first"] else range(4):
                find = short_solve if len(kinds) <= 16 else short_solve.__wrapped__
                audit, end = find(kinds, start, tuple(row["rest"]))
                audit += END[end][1] if row["is_last"] else ""
                out.append({"conv": row["conv"], "seg": row["seg"], "start": start, "end": end, "audit": audit})
        yield pa.RecordBatch.from_pylist(out, SOLVED)


def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, start): the state in which each segment does start."""
    for t, at in groups(batches, ["conv"]):
        rows, out = t.to_pylist(), []
        for lo, hi in zip(at[:-1], at[1:]):
            state, seg = NOTHING, None
            for r in rows[lo:hi]:  # by segment and start
                if r["seg"] != seg and r["start"] == state:
                    out.append({"conv": r["conv"], "seg": r["seg"], "start": state})
                    state, seg = r["end"], r["seg"]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("start", pa.int32())]))


ROW_EDITS = pa.schema([("__at", pa.int64()), ("before", pa.list_(pa.string())), ("new_role", pa.string()),
                       ("stays", pa.bool_()), ("behind", pa.list_(pa.string()))])
ROW_EDITS_SQL = "__at long, before array<string>, new_role string, stays boolean, behind array<string>"


def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in b.to_pylist():
            edits = apply_audit([c >> 2 for c in row["codes"]], row["start"], row["audit"])
            out += [dict(zip(ROW_EDITS.names, (row["first_at"] + k, *e))) for k, e in enumerate(edits)]
        yield pa.RecordBatch.from_pylist(out, ROW_EDITS)


@dataclass
class Repaired:
    """``report``: per conversation conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit.  ``turns``: the repaired rows conv_id,
    place (their order), role, text."""

    report: DataFrame
    turns: DataFrame


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> Repaired:
    rows = ordered_rows(conversations, conv, turn, role, text)
    codes = stage(coded_rows(rows), "codes")
    segs = segments_of(codes)

    def by_conv(df: DataFrame, *order: str) -> DataFrame:
        n = partitions_of(df)
        return df.repartition(n, "conv").sortWithinPartitions("conv", *order)

    m = segs.select("conv", "seg", "codes").mapInArrow(matrices, MATRICES_SQL)
    edge = stage(by_conv(m, "seg").mapInArrow(borders, BORDERS_SQL), "borders")
    found = segs.join(edge.select("conv", "seg", "rest", "is_first", "is_last"), ["conv", "seg"])
    found = stage(found.mapInArrow(solved, SOLVED_SQL), "solved")
    pick = by_conv(found.drop("audit"), "seg", "start").mapInArrow(chosen, "conv long, seg long, start int")
    audits = stage(found.join(pick, ["conv", "seg", "start"]), "audits")

    fault = F.col("code").bitwiseAND(F.lit(3))
    counts = codes.groupBy("conv").agg(*[F.count_if(fault == k).alias(n) for k, n in
                                         ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    whole = audits.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
        .alias("audit"))
    totals = edge.where("is_first").select("conv", "cost", "illegal")
    report = turns.join(counts, "conv").join(totals, "conv").join(whole, "conv").select(
        unrid("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = segs.join(audits, ["conv", "seg"]).select("first_at", "codes", "start", "audit").mapInArrow(
        edits_of, ROW_EDITS_SQL)

    def inserted(name: str) -> F.Column:
        return F.transform(name, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

    own = F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))
    parts = F.concat(inserted("before"), F.when(F.col("stays"), F.array(own)).otherwise(F.array().cast(
        "array<struct<role:string,text:string>>")), inserted("behind"))
    lines = rows.select("conv", "role", "text", "__at").join(edits, "__at")
    lines = lines.select("conv", "__at", F.posexplode(parts).alias("k", "line"))
    return Repaired(report, lines.select(
        unrid("conv").alias("conv_id"), F.struct("__at", "k").alias("place"), "line.role", "line.text"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256): of the lines ``role:text`` of each conversation,
    joined by line ends."""
    lines = turns.select(rid("conv_id").alias("conv"), "place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition(partitions_of(lines), "conv").sortWithinPartitions("conv", "place")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            done = []
            for c, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            yield batch(done)
        if digest is not None:
            yield batch([(conv, digest.hexdigest())])

    def batch(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv", "sha256"])

    return lines.select("conv", "line").mapInArrow(stream, "conv long, sha256 string").select(
        unrid("conv").alias("conv_id"), "sha256")


# ------------------------------------------------------------------- damage
def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with reproducible faults, by crc32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its ``[.!?]``, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    space = F.lit(" ")

    def words(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), space)

    kind = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        words("role").alias("role"), words("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report on the damaged conversations, one row for every original
    conversation, with the digest of the repaired rows."""
    fixed = repair(damaged(conversations))
    every = conversations.select(rid("conv_id").alias("conv")).distinct()
    report = fixed.report.withColumn("conv", rid("conv_id")).drop("conv_id")
    sha = digests(fixed.turns).select(rid("conv_id").alias("conv"), "sha256")
    nothing = hashlib.sha256(b"").hexdigest()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(report, "conv", "left").join(sha, "conv", "left").select(
        unrid("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
