"""Quality rules with the frequency of lines across a host's documents.

Each document gets counts of words, symbols, repeated lines and words in
repeated windows. Its lines are normalised and hashed; a line that as many of
a host's documents hold as the limit says is removed, and a document that
loses too many of its words with such lines is rejected. The limit is a count
that does not grow with the host. Copies are one document for it: texts of a
host are counted, each once, so that copies alone make no line frequent.

Repeated rows all get the same verdict. Null text: as empty, no words, so the
base rule rejects it. Null doc_id: stays null. A null or empty host is one
host of its own. Very long texts are read whole. Ties don't arise. Empty
table: no rows. Other columns, whatever their names, are not read by
judge_documents and pass through clean_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _key() -> Column:
    """Names a document: 128 bits over doc_id, host and text."""
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "source"))
    return F.unhex(F.md5(F.concat_ws("\x01", *parts, text_or_empty()).cast("binary")))


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def _words(c: Column) -> Column:
    trimmed = _trim(c)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def normalise(line: Column) -> Column:
    """Lower case, single spaces, numbers as 0."""
    return F.lower(F.regexp_replace(F.regexp_replace(_trim(line), WHITE, " "), "[0-9]+", "0"))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines (hash and words of each line with a word)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("_t", t).withColumn("_w", _words(F.col("_t")))
    out = out.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    out = out.withColumn("_g", F.when(F.size("_w") < 3, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window)))
    # windows sorted with their places: equal ones are neighbours
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_p", F.when(some, pairs).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    same = lambda x, i: F.coalesce(x["h"] == F.get("_p", i)["h"], F.lit(False))
    out = out.withColumn("_i", F.sort_array(F.transform(F.filter("_p", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_i", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get("_i", k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.transform("_l", lambda x: F.struct(F.xxhash64(normalise(x)).alias("line"), F.size(_words(x)).alias("words"))).alias("lines"),
    )


def _measure(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), _key().alias("key"), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("copy"), text_or_empty().alias("text"))
    return materialise(text_statistics(rows).drop("text"), "line-statistics")


def _removed(measured: DataFrame, least_docs: int, share: float) -> DataFrame:
    """host, line of the lines to remove.

    Counting goes by (host, line), never by host alone, and starts before the
    shuffle; the number of texts of a host is one row for each host.
    """
    distinct = measured.select("host", "copy", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    counts = distinct.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs)
    if share > 0:
        hosts = measured.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
        counts = counts.join(hosts, "host").filter(F.col("docs") > F.col("host_docs") * share)
    return counts.select("host", "line")


def _verdicts(docs: DataFrame, least_docs: int, share: float, most_lost: float) -> DataFrame:
    """The measured rows with gone (hashes of removed lines), lost (their words), base_failed and kept."""
    measured = _measure(docs)
    removed = _removed(measured, least_docs, share)
    lines = measured.select("key", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    gone = lines.join(removed, ["host", "line"]).groupBy("key").agg(F.collect_set("line").alias("gone"))
    judged = measured.join(gone, "key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
    lost = F.aggregate(F.filter("lines", lambda x: F.array_contains("gone", x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("lost", F.when(F.size("gone") > 0, lost).otherwise(F.lit(0).cast("long"))).withColumn("base_failed", base_failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= F.col("n_words") * most_lost))


def judge_documents(docs: DataFrame, least_docs: int = 20, share: float = 0.0, most_lost: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept and lost_words of each row.

    least_docs, share: a line goes if at least so many, and if share is above 0
    also more than this share, of its host's texts hold it. most_lost: a
    document is rejected that loses more than this share of its words.
    """
    rows = _verdicts(docs, least_docs, share, most_lost)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("lost").alias("lost_words"))


def clean_documents(docs: DataFrame, least_docs: int = 20, share: float = 0.0, most_lost: float = 0.5) -> DataFrame:
    """The rows of the kept documents, all columns, without the removed lines in text."""
    verdicts = _verdicts(docs, least_docs, share, most_lost).filter("kept").select("key", "gone").groupBy("key").agg(F.first("gone").alias("gone"))
    # the row is carried as one column, so its names can't clash with these
    rows = docs.select(_key().alias("key"), F.struct("*").alias("row")).join(verdicts, "key")
    left = F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normalise(x))))
    text = F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(F.col("row.text"))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def oracle(least_docs: int = 20, share: float = 0.0, most_lost: float = 0.5) -> str:
    """judge_documents in DuckDB SQL."""
    word, has_word = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    count_words = f"len(regexp_extract_all({{}}, '{word}'))"
    normal = f"regexp_replace(lower(array_to_string(regexp_extract_all(l, '{word}'), ' ')), '[0-9]+', '0', 'g')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS s(k) GROUP BY r),
lines AS (SELECT r, host, l, {normal} AS line, {count_words.format('l')} AS words FROM (SELECT r, host, unnest(str_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{has_word}')),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM lines JOIN d USING (r, host) GROUP BY host, line) JOIN hosts USING (host)
  WHERE n >= {least_docs} AND n > host_docs * {share!r}::DOUBLE),
lost AS (SELECT r, sum(words) AS n FROM lines JOIN frequent USING (host, line) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r))
SELECT *, base_failed = FALSE AND lost_words <= n_words * {most_lost!r}::DOUBLE AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
"""
