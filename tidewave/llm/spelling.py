"""Spelling variants: words at an edit distance of one, found by a prefix filter over rare bigrams.

A word's bigrams are put in one global order: by how many words hold the
bigram, then by the bigram, then by place. One edit touches at most two bigrams
of a word, and what it leaves keeps its order; so two words that one edit
parts share one of the three rarest bigrams of each, at places at most one
apart. Only those three are joined. Such a bigram lies wholly on one side of
the edit, so the words agree from their start through it or from it to their
end, and in one half of the rest as well: the join's key is that stretch with a
half of the rest, which holds the limit on places. What meets is verified by
the edit distance. Adaptive execution splits keys that many words share.

Words of a form make a chain of rising counts; the chains are followed by
doubling.

Words are runs of letters of whole texts (A-Z as a-z); one run in 97 by
checksum has lost a letter. Null text: no runs. Null doc_id: counts as the
empty text in the checksum. Repeated rows: each counts. Very long texts and
words are read whole. Ties between forms: the first in code-point order. Empty
table: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, mix, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
PREFIX = 3


def _without(word: Column, place: Column) -> Column:
    """The word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int = 97) -> DataFrame:
    """word, n of the runs after damage (0: none), of at least so many letters and occurrences."""
    lower = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # shorter runs can't become words
    runs = F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]+"), F.lit(0))
    rows = docs.select(key.alias("key"), F.explode(runs).alias("run")).filter(F.length("run") >= least_length)
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
        word = F.when(h % damage == 0, _without(F.col("run"), (h % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def bigram_counts(words: DataFrame) -> DataFrame:
    """gram, held: how many words hold it. At most the square of the number of letters: 8,100 rows for words of count_words."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.array_distinct(F.transform(places, lambda p: F.substring(F.col("word"), p, F.lit(2))))
    return words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and len(texts) + 1 offsets."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64))])


def _ranked(grams: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams as numbers, ascending, and their places in the global order."""
    points, _ = _codes(grams)
    number = (points[::2].astype(np.uint64) << np.uint64(32)) | points[1::2]
    rank = np.empty(len(number), np.int64)
    rank[np.lexsort((number, held.to_numpy()))] = np.arange(len(number))
    by = np.argsort(number)
    return number[by], rank[by]


class _Stretches:
    """Hashes of stretches of a text by those of its beginnings."""

    def __init__(self, points: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        def powers(of: int) -> np.ndarray:
            out = np.full(len(points) + 1, of, np.uint64)
            out[0] = 1
            return np.cumprod(out)

        # sums of letters times falling powers: a difference and a product give a stretch's, wherever it stands
        self.power = powers(base)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers(pow(base, -1, 1 << 64))[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.power[start]


def _rarest(points: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word, place of the bigram in all letters) of the PREFIX rarest bigrams of each word."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(of[1:] == of[:-1])
    number = (points[at].astype(np.uint64) << np.uint64(32)) | points[at + 1]
    order = np.lexsort((at, table[1][np.searchsorted(table[0], number)], of[at]))
    at, word = at[order], of[at[order]]
    place = np.arange(len(word)) - np.searchsorted(word, word)
    return word[place < PREFIX], at[place < PREFIX]


def _keys(points: np.ndarray, offsets: np.ndarray, word: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(word, key, whether for the longer word of a pair).

    A pair shares a stretch from the start through a bigram, or from it to the
    end, and of the rest, cut as the shorter word's is, the first or last half.
    """
    stretch = _Stretches(points)
    start, end = offsets[word], offsets[word + 1]
    out = []
    for side, (a, b, c, d) in enumerate(((start, at + 2, at + 2, end), (at, end, start, at))):
        shared = stretch(a, b)
        for longer in (False, True):
            n = d - c - longer
            half = n // 2
            for which, (x, y) in enumerate(((c, c + half), (d - (n - half), d))):
                some = n >= 0
                salt = np.uint64(2 * side + which)
                key = mix(mix(shared + salt) + n.astype(np.uint64)) + stretch(np.where(some, x, c), np.where(some, y, c))
                out.append((word[some], mix(key[some]), longer))
    return out


def prefix_keys(words: DataFrame) -> DataFrame:
    """key, longer, word, n: the keys under which a word meets those at a distance of one; words(word, n)."""
    grams = bigram_counts(words).toArrow()
    table = words.sparkSession.sparkContext.broadcast(_ranked(grams["gram"].combine_chunks(), grams["held"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, offsets = _codes(batch.column("word"))
            for word, key, longer in _keys(points, offsets, *_rarest(points, offsets, table.value)):
                taken = batch.take(pa.array(word))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(word), longer)), taken.column("word"), taken.column("n")], names=["key", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, longer boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each two words with an edit distance of one, once, the longer one as b; words(word, n), of four letters or more."""
    keyed = materialise(prefix_keys(words), "prefix-keys")
    left = keyed.filter("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = F.when(F.col("longer"), F.length("b") == F.length("a") + 1).otherwise((F.length("b") == F.length("a")) & (F.col("a") < F.col("b")))
    return left.join(right, "key").filter(near & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b").distinct()


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: form is the near word of the largest count, if that is at least ratio times the word's."""
    words = materialise(words.select("word", "n"), "words")
    pairs = materialise(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    some = words.join(best, "word", "left").withColumn("form_n", -F.col("best.down"))
    held = F.col("form_n") >= F.col("n") * ratio
    formed = materialise(some.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("best.near")).alias("form"), F.when(held, F.col("form_n")).alias("form_n")), "forms")
    # counts at least double from form to form, so chains are short
    up = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        after = materialise(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        up = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            break
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int = 97, ratio: int = 2) -> DataFrame:
    """The forms of the words of documents; damage: of so many runs one has lost a letter, 0 none."""
    return spelling_forms(count_words(docs, least_length, least_count, damage), ratio)


def oracle(least_length: int = 5, least_count: int = 3, damage: int = 97, ratio: int = 2) -> str:
    """group_spellings in DuckDB SQL, with pairs by patterns with a hole."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE steps AS (
  SELECT i AS b, 0 AS k, i AS c FROM range(256) r(i) UNION ALL SELECT b, k + 1, {step} FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS key, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) AS run FROM documents),
bytes AS (
  SELECT run, flatten(list_transform(str_split(key || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x) >> 6)::BIGINT, 128 | (unicode(x) & 63)::BIGINT] END)) AS b
  FROM runs WHERE length(run) >= {least_length}),
hashed AS (SELECT run, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc_table),
damaged AS (SELECT CASE WHEN h % {damage} = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= {least_length} GROUP BY word HAVING count(*) >= {least_count}),
cut AS (SELECT word, n, i, word[1:i] AS a, word[i + 2:] AS z FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.a || '?' || x.z = y.a || '?' || y.z AND x.word <> y.word
  UNION SELECT c.word, o.word, o.n FROM cut c JOIN v o ON c.a || c.z = o.word
  UNION SELECT o.word, c.word, c.n FROM cut c JOIN v o ON c.a || c.z = o.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(down := -other_n, other := other)) AS b FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.down >= {ratio} * n THEN b.other END AS form, CASE WHEN -b.down >= {ratio} * n THEN -b.down END AS form_n
  FROM v LEFT JOIN best USING (word)),
climb AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM climb c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM climb c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
