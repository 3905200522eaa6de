import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from corpora import ROWS, SCHEMA, table
from pyspark.sql import functions as F
from tidewave.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


TEXTS = ["a b a b a b a b", "x\ny\nx\n\n \nx", "# 😀 é|* $% a&b <>", "a b c d a b c e a b c", "w " * 60, " ".join(f"w{i}" for i in range(60)), "\x0b\x0ca\x1cb\x85c　d"]


def test_base_counts(spark):
    rows = [*ROWS, *((100 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS))]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge_documents(table(spark, rows)).collect())
    want = Counter((r[0], *(c := base(r[1])), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in rows)
    assert got == want


def name(*numbers):
    """Numbers in letters, which normalising leaves apart."""
    return "q".join("".join(chr(97 + int(d)) for d in str(n)) for n in numbers)


def host(n, own, shared="Shared line 2024 here"):
    return [(i, "\n".join([shared.replace("2024", str(2000 + i)), *(f"own {name(i, k)} " + " ".join(name(i, k, j) for j in range(8)) for k in range(own))]), "en", "h", 1, 1, "n", 0.5, "b", "h") for i in range(n)]


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    boiler = "\n".join(f"Boiler {name(k)} " + " ".join(name(k, j) for j in range(10)) for k in range(6))
    rows = host(20, 8) + [(100 + i, boiler + f"\nonly {name(i)}", "en", "h", 1, 1, "n", 0.5, "b", "h") for i in range(12)]
    rows += [(200, boiler, "en", "other", 1, 1, "n", 0.5, "b", "h")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r.kept for r in quality.judge_documents(docs, least_docs=10).collect()}
    assert all(kept[i] for i in range(20)) and not any(kept[100 + i] for i in range(12)) and kept[200]
    clean = quality.clean_documents(docs, least_docs=10)
    assert clean.schema == docs.schema
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {*range(20), 200} and texts[200] == boiler
    assert all(t.startswith("own ") and len(t.split("\n")) == 8 for i, t in texts.items() if i < 20)


def test_few_documents_lose_nothing(spark):
    docs = spark.createDataFrame(host(5, 8), SCHEMA)
    assert {r.lost_words for r in quality.judge_documents(docs).collect()} == {0}
    assert quality.judge_documents(table(spark, [])).count() == 0
    assert quality.clean_documents(table(spark, [])).count() == 0


def test_depleted_documents_among_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    boiler = "\n".join(f"Boiler {name(k)} " + " ".join(name(k, j) for j in range(10)) for k in range(6))
    row = lambda i, text: (1_000_000 + i, text, "en", "src0", 1)
    page = lambda i, n: boiler + f"\nonly {name(i)} " + " ".join(name(i, j) for j in range(n))
    planted = [row(i, page(i, 20)) for i in range(30)] + [row(100 + i, page(i, 200)) for i in range(30)] + [row(200, boiler)] * 50
    before = {r.doc_id: r for r in quality.judge_documents(docs).collect()}
    after = {r.doc_id: r for r in quality.judge_documents(docs.unionByName(spark.createDataFrame(planted, docs.schema))).collect()}
    assert {k: r for k, r in after.items() if k < 1_000_000} == before
    assert not any(after[1_000_000 + i].kept or after[1_000_000 + i].base_failed for i in [*range(30), 200])
    assert all(after[1_000_100 + i].kept and after[1_000_100 + i].lost_words == 72 for i in range(30))
    assert sum(r.lost_words > 0 for r in before.values()) > 1000


def test_copies_make_no_line_frequent(spark):
    text = "\n".join(f"line {name(k)} " + " ".join(name(k, j) for j in range(10)) for k in range(8))
    docs = spark.createDataFrame([(i, text, "en", "h", 1, 1, "n", 0.5, "b", "h") for i in range(100)], SCHEMA)
    assert {(r.kept, r.lost_words) for r in quality.judge_documents(docs).collect()} == {(True, 0)}


def check_sql(df, sql):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    names = sorted(df.columns)
    want = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    assert Counter(tuple(r) for r in df.select(*names).collect()) == want


def test_against_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_sql(quality.judge_documents(docs, least_docs=3, share=0.02, most_lost=0.1), quality.oracle(3, 0.02, 0.1))
    check_sql(quality.judge_documents(docs), quality.oracle())
    check_sql(mixing.mix_sources(docs, max_repeats=3.0, block_docs=50), mixing.oracle(3.0, 50))


def sources(rows):
    n = defaultdict(int)
    for r in rows:
        n[r[3] or ""] += len(WORD.findall(r[1] or "")) + 1
    return n


def test_mix_of_awkward_rows(spark):
    rows = mixing.mix_sources(table(spark), max_repeats=4.0, block_docs=3, keep=["text", "hash"]).collect()
    taken = Counter(r.doc_id for r in rows)
    assert all(taken[r[0]] >= 1 for r in ROWS)  # no source is cut
    whole = sources(ROWS)
    used = defaultdict(int)
    for r in rows:
        used[r.source or ""] += r.tokens
    assert all(used[s] <= 4.0 * whole[s] + 1 for s in whole)
    assert mixing.mix_sources(table(spark, []), max_repeats=2.0).count() == 0
    places = defaultdict(set)
    for r in rows:
        key = (r.block_place, r.slot)
        assert key not in places[r.source, r.epoch]
        places[r.source, r.epoch].add(key)


def test_null_ids_are_dealt_over_blocks_and_repeats_keep_all_columns(spark):
    rows = [(None, f"text number {i}", "en", f"s{i % 3 == 0}", i) for i in range(600)]
    docs = table(spark, rows).withColumns({c: F.lit(1) for c in mixing.PLACES[2:]})
    got = mixing.mix_sources(docs, max_repeats=2.0, block_docs=20)
    sizes = Counter((r.source, r.epoch, r.block) for r in got.collect())
    assert max(sizes.values()) < 40 and len({b for _, _, b in sizes}) == 30
    again = mixing.repeat_documents(docs, max_repeats=2.0, block_docs=20)
    assert again.schema == docs.schema
    n = Counter(again.collect())
    assert set(n) == set(docs.collect()) and set(n.values()) <= {1, 2} and sum(n.values()) == got.count() > 600
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, max_repeats=2.0, keep=["tokens"])


@pytest.mark.parametrize("target", [0.8, 0.95])
def test_entropy_target_and_budget(spark, target):
    sizes = [(f"s{k}", 10_000 // (k + 1) ** 2) for k in range(8)]
    frame = spark.createDataFrame(sizes, "source string, tokens long")
    alpha, tokens = mixing.bisect_exponent(frame.select("tokens"), entropy=target, budget=50_000)
    w = [n**alpha for _, n in sizes]
    p = [x / sum(w) for x in w]
    assert -sum(x * math.log(x) for x in p) == pytest.approx(target * math.log(8), abs=1e-4) or alpha == pytest.approx(1, abs=1e-6)
    assert tokens == 50_000


def test_a_budget_cuts_sources_by_whole_documents(spark):
    rows = [(i, "w " * 9, "en", "big" if i < 90 else "small", 1, 1, "n", 0.5, "b", "h") for i in range(100)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), max_repeats=2.0, budget=400, block_docs=10).collect()
    n = Counter(r.source for r in got)
    assert n["big"] + n["small"] in (39, 40) and n["small"] <= 20 and n["big"] < 90
    assert n["small"] >= 18
