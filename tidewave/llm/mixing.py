"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent in
[0, 1], normalised. The exponent is bisected: the flattest mix that repeats no
source more often than a limit, or the mix nearest to the source shares whose
entropy reaches a target. Each source then gets its weight's part of the token
budget: whole passes over its documents and a last pass over a part of them,
each pass in an order of its own, by permuted blocks of permuted documents.

A document's tokens are its words and an end mark, so no source has none.
Null or empty source: one source of its own. Null text: as empty. Null doc_id:
as an empty one; blocks are dealt by doc_id and text, so such rows are spread
like others. Repeated rows: each is a document; rows equal in both are in one
block, in any order. Empty table: no rows. Other columns, whatever their
names, are not read by mix_sources and pass through repeat_documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import _words
from .shared import materialise, sums_before, text_or_empty

#: Halvings of the exponent's range, and how many of them one job looks ahead.
STEPS, AHEAD = 24, 6


def bisect_exponent(sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None) -> tuple[float, float]:
    """(exponent, token budget) for sources(tokens), one row each.

    budget None: the least with which no source is cut, so that only the
    repetition of smaller sources makes the mix. entropy: as a part of the
    largest possible, the logarithm of the number of sources. A job sums over
    the sources for every exponent that the next AHEAD steps may ask for; only
    these sums come to the driver.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    n, total, most = sources.agg(F.count("*"), F.sum("tokens"), F.max("tokens")).first()
    if not n:
        return 1.0, 0.0

    known: dict[float, tuple[float, float, float]] = {}

    def at(alpha: float, low: float, high: float) -> tuple[float, float, float]:
        if alpha not in known:
            asked = [alpha] if low == high else [low + (high - low) * k / (1 << AHEAD) for k in range((1 << AHEAD) + 1)]
            share = F.pow(F.col("tokens") / F.lit(float(total)), F.col("alpha"))
            each = sources.select("tokens", F.explode(F.array(*(F.lit(a) for a in asked))).alias("alpha"))
            sums = each.groupBy("alpha").agg(F.sum(share), F.sum(share * F.log(share)), F.max(share / F.col("tokens")), F.min(share / F.col("tokens")))
            for a, z, h, top, least in sums.collect():
                tokens = float(budget) if budget is not None else z / least
                known[a] = math.log(z) - h / z, top / z * tokens, tokens
        return known[alpha]

    low, high = 0.0, 1.0  # the mix at high is allowed, or the limit can't be met
    wanted = None if entropy is None else entropy * math.log(n)
    for _ in range(STEPS):
        mid = (low + high) / 2
        h, repeats, _ = at(mid, low, high)
        if wanted is None:
            low, high = (low, mid) if repeats <= max_repeats else (mid, high)
        else:
            low, high = (mid, high) if h >= wanted else (low, mid)
    alpha = high if wanted is None else low
    return alpha, at(alpha, alpha, alpha)[2]


PLACES = ("doc_id", "source", "tokens", "epoch", "block", "block_place", "slot")


def _digest(*c) -> Column:
    return F.md5(F.concat_ws("|", *c).cast("binary"))


def _mixed(docs: DataFrame, row: Column | None, max_repeats: float | None, entropy: float | None, budget: int | None, block_docs: int) -> DataFrame:
    """PLACES of each document and pass that takes it, and row of docs with them."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    columns = [F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.coalesce("source", F.lit("")).alias("of"), (F.size(_words(text_or_empty())) + 1).cast("long").alias("tokens"), _digest(doc_id, F.md5(text_or_empty().cast("binary"))).alias("name")]
    narrow = materialise(docs.select(*columns), "document-tokens")
    rows = narrow if row is None else docs.select(*columns, row.alias("row"))
    stats = materialise(narrow.groupBy("of").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "source-tokens")
    alpha, tokens = bisect_exponent(stats.select("tokens"), max_repeats, entropy, budget)
    n_docs, total = stats.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(1))).first()
    n_blocks = max(1, -(-n_docs // block_docs))
    share = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
    norm = stats.agg(F.coalesce(F.sum(share), F.lit(1.0))).first()[0]
    plan = stats.select("of", "tokens", F.floor(share / F.lit(norm) * F.lit(tokens) + 0.5).alias("part")).select("of", F.floor(F.col("part") / F.col("tokens")).alias("full"), (F.col("part") % F.col("tokens")).alias("left"))
    block = (F.conv(F.substring("name", 1, 8), 16, 10).cast("long") % n_blocks).cast("int")
    sizes = narrow.groupBy("of", block.alias("block")).agg(F.sum("tokens").alias("size")).join(plan, "of")
    passes = F.sequence(F.lit(0).cast("long"), F.col("full"))
    sizes = sizes.withColumn("epoch", F.explode(passes)).filter("epoch < full OR left > 0").withColumn("turn", _digest("of", "epoch", "block"))
    placed = sums_before(sizes, ["of", "epoch"], ["turn", "block"], {"block_place": F.lit(1), "before": F.col("size")}, "block-places")
    # what the last pass leaves for a block: null in whole passes, for a block that fits too
    placed = placed.withColumn("room", F.when(F.col("epoch") == F.col("full"), F.col("left") - F.col("before"))).filter("room IS NULL OR room > 0")
    chosen = placed.select("of", "block", F.col("epoch").cast("int").alias("epoch"), "block_place", "room")
    taken = rows.withColumn("block", block).join(chosen, ["of", "block"])
    inside = Window.partitionBy("of", "epoch", "block").orderBy("turn", "name")
    taken = taken.withColumn("turn", _digest("name", "epoch"))
    taken = taken.withColumn("slot", F.row_number().over(inside) - 1).withColumn("sum", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return taken.filter("room IS NULL OR sum <= room").select(*PLACES, *(["row"] if row is not None else []))


def mix_sources(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None, block_docs: int = 1_000, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, tokens, epoch, block, block_place, slot: a row for each document and pass that takes it.

    Passes over a source are epoch 0, 1 ...; within one, blocks are ordered by
    block_place and a block's documents by slot. The last pass takes whole
    blocks while they fit into what is left of the source's tokens, and of the
    next block the documents that fit, in order. keep: further columns of docs
    to carry along, of other names than these.
    """
    rest = [c for c in keep or [] if c not in ("doc_id", "source")]
    if clash := set(rest) & set(PLACES):
        raise ValueError(f"can't be kept under their names: {sorted(clash)}")
    out = _mixed(docs, F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else None, max_repeats, entropy, budget, block_docs)
    return out.select(*PLACES, "row.*") if rest else out


def repeat_documents(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None, block_docs: int = 1_000) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    return _mixed(docs, F.struct("*"), max_repeats, entropy, budget, block_docs).select("row.*")


def oracle(max_repeats: float, block_docs: int = 1_000) -> str:
    """mix_sources with a limit of repeats and no budget, in DuckDB SQL."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT *, ('0x' || substr(name, 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {block_docs}.0))::BIGINT FROM documents) AS block
  FROM (SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS name FROM documents)),
t AS (SELECT s, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM d) AS share FROM d GROUP BY s),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT k + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid, (SELECT max(pow(share, (low + high) / 2) / tokens) / min(pow(share, (low + high) / 2) / tokens) FROM t) <= {max_repeats!r} AS fits FROM steps WHERE k < {STEPS})),
mix AS (SELECT s, tokens, pow(share, (SELECT high FROM steps WHERE k = {STEPS})) AS w FROM t),
plan AS (
  SELECT s, part // tokens AS full_passes, part % tokens AS rest
  FROM (SELECT s, tokens, floor(w / (SELECT sum(w) FROM mix) * (SELECT sum(w) / min(w / tokens) FROM mix) + 0.5)::BIGINT AS part FROM mix)),
sizes AS (SELECT s, block, sum(tokens)::BIGINT AS size, full_passes, rest FROM d JOIN plan USING (s) GROUP BY ALL),
passes AS (SELECT *, e::BIGINT AS epoch FROM (SELECT *, unnest(range(0, full_passes + 1)) AS e FROM sizes) WHERE e < full_passes OR rest > 0),
placed AS (
  SELECT s, block, epoch, full_passes, rest, row_number() OVER o - 1 AS block_place, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS before FROM passes
  WINDOW o AS (PARTITION BY s, epoch ORDER BY md5(s || '|' || epoch || '|' || block), block)),
chosen AS (SELECT s, block, epoch, block_place, CASE WHEN epoch = full_passes THEN rest - before END AS room FROM placed WHERE epoch < full_passes OR rest > before),
taken AS (
  SELECT doc_id, source, tokens, epoch, block, block_place, room, row_number() OVER w - 1 AS slot, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far FROM d JOIN chosen USING (s, block)
  WINDOW w AS (PARTITION BY s, epoch, block ORDER BY md5(name || '|' || epoch), name))
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch::INTEGER AS epoch, block::INTEGER AS block, block_place::BIGINT AS block_place, slot::INTEGER AS slot FROM taken WHERE room IS NULL OR so_far <= room
"""
