import random
import re
import time
from collections import Counter

import duckdb
import pyarrow as pa
from tidewave.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, place long, hash string, level int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", 1) for r in rows], SCHEMA)


def parse(text):
    lines = []
    for raw in (text or "").split("\n"):
        m = re.match(r"((?:[ \t]*>)+)", raw)
        lines.append((m[1].count(">") if m else 0, re.sub(r"\s+", " ", raw[m.end() :] if m else raw).strip(" ").lower()))
    found, run, level = set(lines), [], None
    for lv, body in [*lines, (-1, "")]:
        if body and lv == level:
            run.append(body)
            continue
        if len(run) > 1:
            found.add((level, " ".join(run)))
        run, level = ([body], lv) if body else ([], None)
    return {x for x in found if re.search(r"[^\W_]", x[1])}


def brute(rows):
    """(conv, turn, text) -> parent's turn, linked, depth, with messages ordered by turn and text."""
    out = Counter()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    for conv, ms in by_conv.items():
        ms.sort(key=lambda r: (-1 if r[1] is None else r[1], r[3] or ""))
        parsed, depth = [parse(m[3]) for m in ms], []
        for i, m in enumerate(ms):
            votes = Counter()
            for level, body in parsed[i]:
                if level:
                    source = next((j for j in reversed(range(i)) if (0, body) in parsed[j]), None)
                    if source is not None:
                        votes[level, source] += 1
            parent = max(((-lv, n, s) for (lv, s), n in votes.items()), default=(0, 0, i - 1))[2]
            depth.append(depth[parent] + 1 if parent >= 0 else 0)
            out[conv, m[1], m[2], ms[parent][1] if parent >= 0 else None, bool(votes), depth[i]] += 1
    return out


def result(df):
    return Counter((r.conv_id, r.turn, r.role, r.reply_to, r.linked, r.depth) for r in df.collect())


ROWS = [
    (1, 0, "a", "First point here.\nSecond point there.\n\nA closing line."),
    (1, 1, "b", "> First point here.\n> Second   POINT there.\nI agree.\nReally."),
    (1, 2, "c", "On Monday a wrote:\n> A closing line.\nNo, not so."),
    (1, 3, "d", ">> First point here.\n> I agree.\n> Really.\nMe too."),
    (1, 4, "a", "Nothing quoted"),
    (1, 5, "b", "> never said\nhm"),
    (1, 6, "b", "> > First point here.\nonly a deeper quote"),
    (2, 0, "a", None),
    (2, 0, "a", ""),
    (2, 1, "b", "> I agree.\nfrom another conversation"),
    (2, None, "b", "no turn"),
    (3, 7, "a", "same"),
    (3, 7, "a", "same"),
    (3, 8, "b", "> same\nreply"),
    (None, 1, "x", "without a conversation"),
    (None, 2, "x", "> without a conversation"),
]


def test_links_and_depths(spark):
    assert result(quotes.link_quotations(frame(spark, ROWS))) == brute(ROWS)


def test_bodies_and_places(spark):
    rows = quotes.link_quotations(frame(spark, ROWS)).collect()
    bodies = {(r.conv_id, r.turn): r.body for r in rows if r.conv_id == 1}
    assert bodies[1, 2] == "No, not so." and bodies[1, 1] == "I agree.\nReally." and not any(">" in b for b in bodies.values())
    for conv in {r.conv_id for r in rows}:
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert [r.depth for r in mine] == sorted(r.depth for r in mine)


def test_sources_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 2)
    rows = [(1, i, "a", f"line {i % 3}\nline x{i}") for i in range(9)] + [(1, 9 + i, "b", f"> line {i}\n> line x{i}\nreply {i}") for i in range(9)]
    assert result(quotes.link_quotations(frame(spark, rows))) == brute(rows)


def quoted_table(n=3_000, seed=3):
    """Conversations whose messages quote earlier ones, at several levels, whole passages or lines, or what nobody said."""
    rng = random.Random(seed)
    words = ["point", "plan", "cost", "Line", "é", "data", "2024", "we", "think"]
    rows, said = [], {}
    for i in range(n):
        conv = rng.randrange(n // 40) if rng.random() < 0.7 else 0  # one has a third of all
        mine = said.setdefault(conv, [])
        lines = []
        for _ in range(rng.randrange(4)):
            if mine and rng.random() < 0.7:
                old = rng.choice(mine).split("\n")
                a = rng.randrange(len(old))
                mark = rng.choice(["> ", ">", "> > ", ">>"])
                if rng.random() < 0.3:
                    lines.append("On that day somebody wrote: ")
                lines += [mark + x for x in old[a : a + rng.randrange(1, 4)]]
            if rng.random() < 0.3:
                lines.append("")
            lines += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3))]
        text = "\n".join(lines)
        rows.append((conv, len(mine), rng.choice("ab"), text))
        mine.append(text)
    return rows


def test_a_quoted_table_against_brute_force_and_sql(spark):
    rows = quoted_table()
    got = quotes.link_quotations(frame(spark, rows))
    assert result(got) == brute(rows)
    assert got.filter("linked").count() > 1000
    con = duckdb.connect()
    con.register("conversations", pa.table({c: [r[k] for r in rows] for k, c in enumerate(["conv_id", "turn", "role", "text"])}))
    names = ["conv_id", "turn", "role", "body", "reply_to", "linked", "depth", "place"]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(con.execute(f"SELECT {', '.join(names)} FROM ({quotes.oracle()})").fetchall())


def test_long_messages_take_linear_time(spark):
    long = "\n".join(f"own line {i}" for i in range(40_000))
    rows = [(1, 0, "a", long), (1, 1, "b", "\n".join("> " + x for x in long.split("\n"))), (1, 2, "c", "\n\n".join(f"> own line {i}" for i in range(20_000)))]
    began = time.time()
    got = {r.turn: (r.reply_to, r.linked) for r in quotes.link_quotations(frame(spark, rows)).collect()}
    assert got == {0: (None, False), 1: (0, True), 2: (0, True)} and time.time() - began < 60


def test_the_table_and_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in docs.collect()]
    assert result(quotes.link_quotations(docs)) == brute(rows)
    assert quotes.link_quotations(frame(spark, [])).count() == 0
