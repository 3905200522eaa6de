"""Repair of conversations against a search over all edits, and in blocks of every size."""

import hashlib
import heapq
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewave.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, conv int, place string, code string, fault string"


def cheapest(rows):
    """(cost, audit, repaired) by search: the cheapest first, of equal cost the first in ASCII. rows: (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (at, last) in done:
            continue
        done.add((at, last))
        follow = "a" if last == "u" else "u"
        name = {"a": "assistant", "u": "user"}[follow]
        steps = [(3, "I", at, follow, (*out, f"{name}:"))]
        if at < len(rows):
            role, text, fault = rows[at]
            steps.append((4, "D", at + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                steps.append((3 + more, "R", at + 1, follow, (*out, f"{name}:{text}")))
                if role[:1] == follow or (role[:1] == "s" and last == ""):
                    steps.append((more, "K", at + 1, role[:1], (*out, f"{role}:{text}")))
        for c, e, i, s, o in steps:
            heapq.heappush(heap, (cost + c, audit + e, i, s, o))
    raise AssertionError


def brute(rows):
    """The report by conv_id of rows (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else x
    damaged = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        damaged[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = set()
    for conv, some in damaged.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in some:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t for t, _, _ in some if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, repaired = cheapest(judged)
        n = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "c", "f") for r in rows], SCHEMA)


def test_of_the_driver_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert len({w[7] for w in want}) > 20
    assert found(turns.audit_conversations(df)) == want


def awkward():
    texts = ["Yes.", "No!", "cut", "", " \t\x0b", None, "Long. " * 20_000, "é?", "a\nb.", "Yes."]
    roles = ["user", "assistant", "system", None, "tool", "", "user", "assistant"]
    rows = [(k % 7, k // 7 if k % 11 else None, roles[(k * k + k // 3) % 8], texts[(k * 3 + k // 5) % 10]) for k in range(300)]
    return [*rows, (None, 0, "user", "Hello."), (None, None, "assistant", "Well."), (None, None, "assistant", "Well."), (50, None, None, None), *rows[:5]]


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_awkward_rows_in_blocks(spark, size):
    assert found(turns.audit_conversations(table(spark, awkward()), size)) == brute(awkward())


def test_conversations_that_lose_all_rows(spark):
    rows = [(k, t, "user", "x.") for k in range(400) for t in range(1) if zlib.crc32(f"{k}:{t}".encode()) % 20 == 0]
    assert len(rows) > 5
    got = found(turns.audit_conversations(table(spark, rows)))
    assert got == brute(rows) and {r[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table(spark):
    assert turns.audit_conversations(table(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("suaxSUAX0123", max_size=14), st.integers(1, 5))
def test_costs_walks_and_blocks(codes, size):
    """Against the search; and blocks strung together are as the whole."""
    kinds = ["duplicate" if c in turns.GONE else "truncated" if c.isupper() else None for c in codes]
    cost, audit, _ = cheapest([(c, "t", k) for c, k in zip(codes.translate(turns.TO_INITIALS), kinds, strict=True)])
    costs = turns.costs_to_go(codes, turns.END)
    edits, state = turns.walk(codes, costs, turns.START)
    assert (costs[0][turns.START], edits + turns.ending(state)) == (cost, audit)
    blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
    matrices = [{"block": k, "costs": turns.block_costs(b)} for k, b in enumerate(blocks)]
    end = {k: e for _, k, e in turns._ends("c", matrices)}
    names = ("conv", "block", "edits", "after", "cost", "illegal", "first", "last")
    walked = [dict(zip(names, turns._walks("c", k, b, end[k])[0], strict=True)) for k, b in enumerate(blocks)]
    if walked:
        _, strung_cost, _, pieces = turns._strung("c", walked)[0]
        assert (strung_cost, "".join(p["edits"] for p in pieces)) == (cost, audit)
