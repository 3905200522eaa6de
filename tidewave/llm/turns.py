"""Repair of conversations to the form (s?(ua)+)? by cheapest edits.

Rows are a conversation's turns in order. A dynamic programme over row and
state of the form (start, after s, after u, after a) gives from the end back
the cost to go from each row and state; a walk from the start then takes among
the edits that lose nothing the one that comes first in ASCII: delete, insert,
keep, rerole. Insert and rerole write the role that the form expects, so the
letters tell the repaired turns.

Rows are taken in blocks of BLOCK. The costs from each state before a block to
each state after it are a matrix; matrices of a conversation, one for a block,
are put together from its end, which gives each block the costs to go at its
end. Each block is walked from all four states, and the walks are strung
together from the start. So no task holds a conversation but in one letter for
a row, which the row that is returned holds as well. The repaired turns are
hashed in order as a stream.

Turns null come first; equal turns are ordered by role and text. Null role or
text: a space; a null conv_id or turn is a space in the checksum that picks the
damage, and a null conv_id is a conversation of its own. A role with another
initial or none is never kept. Empty text: blank. Very long texts are read whole.
Repeated rows are damaged alike and all but the first are duplicates. Empty
table: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import materialise, sums_before

BLOCK = 4096
#: Weights of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state: where insert and rerole lead, and the role that they write.
EXPECTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of inserts that end the form.
END = (0, 2 * INSERT, INSERT, 0)
#: From each state: where a kept row of an initial leads.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: A row's code: its initial (x: another), in upper case if truncated, as a figure if the row must go.
INITIALS, CUT, GONE = "suax", "SUAX", "0123"
TO_INITIALS = str.maketrans(CUT + GONE, INITIALS * 2)
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\f\r"


def damage(conversations: DataFrame) -> DataFrame:
    """conv (a string for conv_id), turn, role, text of the rows after damage, which the checksum of conv_id:turn picks."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(_conv().alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def _conv() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def find_faults(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text) with place, and fault: blank, duplicate, truncated or null."""
    placed = sums_before(rows.withColumn("tie", F.monotonically_increasing_id()), ["conv"], ["turn", "role", "text", "tie"], {"place": F.lit(1)}, "turn-places").drop("tie")
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    placed = materialise(placed.withColumn("said", said), "turns")
    twice = placed.groupBy("conv", "said").agg(F.count("*").alias("times"), F.min("place").alias("first")).filter("times > 1")
    trimmed = F.rtrim("text", F.lit(WHITE))
    fault = F.when(trimmed == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    return placed.join(twice, ["conv", "said"], "left").select("conv", "place", "turn", "role", "text", fault.alias("fault"))


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(F.col("fault").isin("blank", "duplicate"), F.translate(known, INITIALS, GONE)).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


Costs = tuple[int, int, int, int]


def costs_to_go(codes: str, end: Costs) -> list[Costs]:
    """Costs from each row and state to the end, whose own costs are given; the last item is end."""
    out = [end]
    f = end
    for code in reversed(codes):
        g = [f[s] + DELETE for s in range(4)]
        if code not in GONE:
            more = TRUNCATED if code.isupper() else 0
            for s in range(4):
                to = KEPT[s].get(code.lower())
                if to is not None and f[to] + more < g[s]:
                    g[s] = f[to] + more
                if f[EXPECTED[s]] + more + REROLE < g[s]:
                    g[s] = f[EXPECTED[s]] + more + REROLE
        user, assistant = min(g[USER], g[ASSISTANT] + INSERT), min(g[ASSISTANT], g[USER] + INSERT)
        f = (min(g[START], user + INSERT), min(g[SYSTEM], user + INSERT), user, assistant)
        out.append(f)
    out.reverse()
    return out


def walk(codes: str, costs: list[Costs], state: int) -> tuple[str, int]:
    """(edits, state after them): of those that lose nothing the first in ASCII, from a state before the rows."""
    edits = []
    for i, code in enumerate(codes):
        while True:
            now, then = costs[i], costs[i + 1]
            if then[state] + DELETE == now[state]:
                edits.append("D")
                break
            if now[EXPECTED[state]] + INSERT == now[state]:
                edits.append("I")
                state = EXPECTED[state]
                continue
            to = KEPT[state].get(code.lower())
            if to is not None and then[to] + (TRUNCATED if code.isupper() else 0) == now[state]:
                edits.append("K")
                state = to
            else:
                edits.append("R")
                state = EXPECTED[state]
            break
    return "".join(edits), state


def ending(state: int) -> str:
    return "I" * (END[state] // INSERT)


def block_costs(codes: str) -> list[int]:
    """16 costs: from each state before the rows to each state after them."""
    columns = [costs_to_go(codes, tuple(0 if s == e else FAR for s in range(4)))[0] for e in range(4)]
    return [columns[e][s] for s in range(4) for e in range(4)]


def _through(matrix: list[int], end: Costs) -> Costs:
    return tuple(min(matrix[4 * s + e] + end[e] for e in range(4)) for s in range(4))


def _batched(names: list[str], of):
    """A function for mapInArrow: of(row of the named columns) gives output rows (a list of tuples) of the schema's columns."""

    def make(schema: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [x for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True) for x in of(*row)]
                columns = list(zip(*rows, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return run

    return make


def _rows(df: DataFrame, of: Callable, columns: str) -> DataFrame:
    """The rows (tuples of columns, a DDL schema) that of gives for each row of df, in Arrow batches."""
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in of(*row)]
            each = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(each, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, columns)


def _block_costs(conv: str, block: int, codes: str) -> list[tuple]:
    return [(conv, block, block_costs(codes))]


def _ends(conv: str, of: list[dict]) -> list[tuple]:
    end, out = END, []
    for x in reversed(of):
        out.append((conv, x["block"], list(end)))
        end = _through(x["costs"], end)
    return out


def _walks(conv: str, block: int, codes: str, end: list[int]) -> list[tuple]:
    costs, initials = costs_to_go(codes, tuple(end)), codes.translate(TO_INITIALS)
    edits, after = zip(*(walk(codes, costs, s) for s in range(4)), strict=True)
    illegal = sum(x + y not in LEGAL for x, y in pairwise(initials))
    return [(conv, block, list(edits), list(after), costs[0][START], illegal, initials[0], initials[-1])]


def _strung(conv: str, of: list[dict]) -> list[tuple]:
    state, pieces, illegal = START, [], sum(x["illegal"] for x in of)
    illegal += sum(x["last"] + y["first"] not in LEGAL for x, y in pairwise(of))
    for x in of:
        pieces.append({"block": x["block"], "state": state, "edits": x["edits"][state]})
        state = x["after"][state]
    pieces[-1]["edits"] += ending(state)
    return [(conv, of[0]["cost"], illegal, pieces)]


def _edits(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """conv, cost, illegal, audit; and conv, place, inserted (roles before the row), kept, rerole. rows(conv, place, code).

    Inserts after the last row have a place after it.
    """
    ordered = lambda *c: F.sort_array(F.collect_list(F.struct(*c))).alias("of")
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
    blocks = materialise(rows.groupBy("conv", F.floor(F.col("place") / size).alias("block")).agg(codes.alias("codes")), "turn-blocks")
    costs = _rows(blocks.select("conv", "block", "codes"), _block_costs, "conv string, block long, costs array<long>")
    ends = _rows(costs.groupBy("conv").agg(ordered("block", "costs")), _ends, "conv string, block long, end array<long>")
    walked = _rows(blocks.join(ends, ["conv", "block"]).select("conv", "block", "codes", "end"), _walks, "conv string, block long, edits array<string>, after array<long>, cost long, illegal long, first string, last string")
    strung = _rows(walked.groupBy("conv").agg(ordered("block", "edits", "after", "cost", "illegal", "first", "last")), _strung, "conv string, cost long, illegal long, pieces array<struct<block: long, state: long, edits: string>>")
    plan = materialise(strung, "turn-edits")

    def applied(conv: str, block: int, codes: str, state: int, edits: str) -> list[tuple]:
        out, inserted, at = [], [], block * size
        for e in edits:
            if e == "I":
                state = EXPECTED[state]
                inserted.append(ROLE[state])
                continue
            role = None
            if e == "K":
                state = KEPT[state][codes[len(out)].lower()]
            elif e == "R":
                state = EXPECTED[state]
                role = ROLE[state]
            out.append((conv, at + len(out), inserted, e != "D", role))
            inserted = []
        return out + [(conv, at + len(out), inserted, False, None)] * bool(inserted)

    pieces = plan.select("conv", F.explode("pieces").alias("x")).select("conv", "x.*").join(blocks, ["conv", "block"])
    places = _rows(pieces.select("conv", "block", "codes", "state", "edits"), applied, "conv string, place long, inserted array<string>, kept boolean, rerole string")
    return plan.select("conv", "cost", "illegal", F.array_join(F.transform("pieces", lambda x: x["edits"]), "").alias("audit")), places


def repaired_turns(faults: DataFrame, places: DataFrame) -> DataFrame:
    """conv, place, turns (role and text): what each row, with the inserts before it, becomes."""
    added = F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("kept"), F.array(F.struct(F.coalesce("rerole", "role").alias("role"), F.col("text").alias("text"))))
    turns = F.concat(added, F.coalesce(own, F.array().cast("array<struct<role: string, text: string>>")))
    return places.join(faults.select("conv", "place", "role", "text"), ["conv", "place"], "left").select("conv", "place", turns.alias("turns")).filter(F.size("turns") > 0)


def hash_turns(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256: of role:text of a conversation's turns joined by newlines.

    A checksum needs its bytes in order, so a conversation streams through a
    task, sorted and in batches; it is never held.
    """
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv, text in zip(batch.column("conv").to_pylist(), batch.column("lines"), strict=True):
                if conv != now or state is None:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.as_buffer())
            yield _hashes(done)
        yield _hashes([(now, state.hexdigest())] if state is not None else [])

    return turns.select("conv", "place", lines.alias("lines")).repartition("conv").sortWithinPartitions("conv", "place").select("conv", "lines").mapInArrow(run, "conv string, repaired_sha256 string")


def _hashes(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["conv", "repaired_sha256"])


def repair_conversations(conversations: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The report on each conversation, and its repaired turns (conv, place, turns).

    rows(conv, turn, role, text). Report: conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit. size: rows in a block.
    """
    faults = materialise(find_faults(conversations), "faults")
    report, places = _edits(faults.select("conv", "place", _code().alias("code")), size)
    of = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = faults.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), of("blank"), of("duplicate"), of("truncated"))
    return counts.join(report, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired_turns(faults, places)


def audit_conversations(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """Damages the conversations and repairs them: a row for each conv_id, of zeros where no row is left."""
    report, turns = repair_conversations(damage(conversations), size)
    rows = conversations.select("conv_id").distinct().select(F.col("conv_id").cast("long").alias("conv_id"), _conv().alias("conv")).join(report, "conv", "left").join(hash_turns(turns), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id", *map(zero, counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
