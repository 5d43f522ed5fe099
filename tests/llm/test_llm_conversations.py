"""Conversation repair against a plain search over whole audits."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from normsmith.llm import conversation_repair as CR

SF = "/root/testdata/sf0.001"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(initials, faults):
    """All audits, one row at a time, keeping each state's least (cost, audit,
    roles).  Roles: the initial of each line of the result."""
    ok = re.compile("(s?(ua)*u?)?$")

    def state(r):
        return r[-1:] if r else ""

    def close(options):  # insertions, until nothing gets better
        while True:
            new = dict(options)
            for cost, audit, roles, lines in list(options.values()):
                for role in "ua":
                    if ok.match(roles + role):
                        o = (cost + 5, audit + "I", roles + role, [*lines, (role, None)])
                        s = state(o[2])
                        if s not in new or o[:2] < new[s][:2]:
                            new[s] = o
            if new == options:
                return options
            options = new

    options = close({"": (0, "", "", [])})
    for k, (initial, fault) in enumerate(zip(initials, faults)):
        new = {}
        for cost, audit, roles, lines in options.values():
            cand = [(cost + 2, audit + "D", roles, lines)]
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if initial in list("sua") and ok.match(roles + initial):
                    cand.append((cost + extra, audit + "K", roles + initial, [*lines, ("keep", k)]))
                for role in "ua":
                    if ok.match(roles + role):
                        cand.append((cost + 1 + extra, audit + "R", roles + role, [*lines, (role, k)]))
            for c in cand:
                s = state(c[2])
                if s not in new or c[:2] < new[s][:2]:
                    new[s] = c
        options = close(new)
    return min((o for s, o in options.items() if s in ("", "a")), key=lambda o: o[:2])


def brute(rows):
    ids = {r[0] for r in rows}
    out = {c: (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids}

    def order(r):
        return (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])

    for conv, group in groupby(sorted(damage(rows), key=order), key=lambda r: r[0]):
        group = list(group)
        seen, faults = set(), []
        for _, _, role, text in group:
            body = text.strip(" \t\n\x0b\x0c\r")
            dup = (role, text) in seen
            seen.add((role, text))
            faults.append("blank" if not body else "duplicate" if dup else "" if body[-1] in ".!?" else "truncated")
        at = [r[2][:1] for r in group]
        turns = {r[1] for r in group} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(at, at[1:]))
        cost, audit, _, lines = cheapest(at, faults)
        names = {"u": "user", "a": "assistant"}
        text = "\n".join(
            f"{group[k][2] if role == 'keep' else names[role]}:{'' if k is None else group[k][3]}" for role, k in lines)
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return sorted(out.values(), key=str)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def result(spark, rows, schema="conv_id long, turn long, role string, text string"):
    got = CR.repair_damaged(spark.createDataFrame(rows, schema))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_whole_table(spark):
    d = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in CR.repair_damaged(d).collect()), key=str) == brute(rows)


def messy(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for _ in range(rng.randrange(1, most)):
            rows.append((
                rng.choice([conv, conv, conv, None]), rng.choice([None, *range(12)]),
                rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "u", "System"]),
                rng.choice(["a.", "b", "", " \t", None, "c! ", "d?\n", "e", "f.", "a.", "long " * 2000 + "."]),
            ))
    return rows


@pytest.mark.parametrize("bits", [14, 1])
def test_messy_conversations(spark, monkeypatch, bits):
    """Nulls in every column, ties, repeated rows; with segments of two rows
    as well, so that a conversation is put together from many."""
    monkeypatch.setattr(CR, "SEGMENT_BITS", bits)
    rows = messy(bits, 60, 14)
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    assert result(spark, []) == []
    rows = [(c, t, None, None) for c in (1, None) for t in (None, 1)] + [(2, 3, "user", "x")] * 3
    names = "conv_id long, turn long, role string, text string, conv string, __at int, code int, seg int"
    assert result(spark, [(*r, "z", 1, 2, 3) for r in rows], names) == brute(rows)


def test_hirschberg_equals_plain_search():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 40)
        at = [rng.choice("suaauua?") for _ in range(n)]
        faults = [rng.choice(["", "", "truncated", "blank"]) for _ in range(n)]
        kinds = bytes(CR.DELETE if f == "blank" else "sua?".index(a) * 2 + (f != "") for a, f in zip(at, faults))
        audit, end = CR.solve(kinds, CR.NOTHING, [c for c, _ in CR.END])
        want = cheapest(at, faults)
        assert audit + CR.END[end][1] == want[1]
        assert min(c + e for c, (e, _) in zip(CR.forward(kinds, 0), CR.END)) == want[0]


def test_long_conversation_splits_over_tasks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"line {t % 997}.") for t in range(6000)]
    got = result(spark, rows)
    assert got == brute(rows)
