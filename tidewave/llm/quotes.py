"""Linking quotations and ordering conversations by reply.

A line's quote level is the number of > before it. A message's own lines have
none; neighbouring own lines form a passage, and so do neighbouring quoted
lines of a level. Passages and lines are normalised and hashed. A quoted
passage or line is linked to the latest earlier message of its conversation
that has one of that hash as its own. A message replies to the message that
most of its links at its shallowest linked level name (on a tie the latest);
one without links replies to the message before it.

Equal turns of a conversation are ordered by text; repeated rows are messages
of their own, in any order. Null text: an empty message. Null turn: before the
others. A null conv_id is a conversation of its own. Null role: stays null.
Very long messages take time in proportion to their length. Empty table: no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, sums_before, text_or_empty

QUOTE = r"^((?:[ \t]*>)+)"
#: A line that introduces a quotation.
INTRODUCTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
BLOCK = 1024


def normalise(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _passages(messages: DataFrame) -> DataFrame:
    """conv, place, level, hash of each distinct line and passage with a letter or digit."""
    quote = lambda x: F.regexp_extract(x, QUOTE, 1)
    level = lambda x: F.length(quote(x)) - F.length(F.replace(quote(x), F.lit(">"), F.lit("")))
    text_line = F.transform(F.split("text", "\n"), lambda x: F.struct(level(x).alias("level"), normalise(F.regexp_replace(x, QUOTE, "")).alias("body")))
    rows = materialise(messages.select("conv", "place", text_line.alias("l")), "lines")
    # a passage goes on while the level stays and no line is empty: places of its first and of its last line
    apart = lambda i, j: F.coalesce((F.get("l", i)["level"] != F.get("l", j)["level"]) | (F.get("l", j)["body"] == ""), F.lit(True))
    places = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get("l", i)["body"] != "")
    rows = rows.withColumn("first", F.filter(places, lambda i: apart(i, i - 1))).withColumn("last", F.filter(places, lambda i: apart(i, i + 1)))
    several = F.filter(F.arrays_zip("first", "last"), lambda x: x["last"] > x["first"])
    passage = lambda x: F.struct(F.get("l", x["first"])["level"].alias("level"), F.array_join(F.transform(F.slice("l", x["first"] + 1, x["last"] - x["first"] + 1), lambda y: y["body"]), " ").alias("body"))
    some = rows.select("conv", "place", F.explode(F.concat(F.col("l"), F.transform(several, passage))).alias("x"))
    return some.filter(F.col("x.body").rlike(r"[\p{L}\p{N}]")).select("conv", "place", "x.level", F.xxhash64("x.body").alias("hash")).distinct()


def _latest_source(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv, hash, place, source: the latest message before place that has the hash as its own.

    By blocks of messages: the latest inside the block, else the last of the
    blocks before. Rows are distinct, so a block's group has a bound.
    """
    block = F.floor(F.col("place") / BLOCK).alias("block")
    own = own.select("conv", "hash", "place").distinct()
    events = own.select("conv", "hash", "place", block, F.col("place").alias("source")).unionByName(quoted.select("conv", "hash", "place").distinct().select("conv", "hash", "place", block, F.lit(None).cast("long").alias("source")))
    inside = Window.partitionBy("conv", "hash", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("source").over(inside)).filter("source IS NULL").drop("source")
    last = events.groupBy("conv", "hash", "block").agg(F.max("source").alias("last"))
    carried = last.select("conv", "hash", "block", F.max("last").over(Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    return near.join(carried, ["conv", "hash", "block"]).select("conv", "hash", "place", F.coalesce("near", "far").alias("source")).filter("source IS NOT NULL")


def _body(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them."""
    lines = F.split(text, "\n")
    pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda x, y: F.struct(x.alias("line"), F.coalesce(y, F.lit("")).alias("next")))
    own = F.filter(pairs, lambda x: ~x["line"].rlike(QUOTE) & ~(x["line"].rlike(INTRODUCTION) & x["next"].rlike(QUOTE)))
    return F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, reply_to (a turn), linked, depth, place of each message.

    place numbers a conversation's messages by depth, then by turn: each
    follows the message that it replies to.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("tie"))
    messages = materialise(sums_before(rows, ["conv"], ["turn", "text", "tie"], {"place": F.lit(1)}, "message-places").drop("tie"), "messages")
    passages = materialise(_passages(messages), "passages")
    quoted = passages.filter("level > 0")
    own = passages.filter("level = 0").join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    links = quoted.join(_latest_source(own, quoted), ["conv", "hash", "place"])
    votes = links.groupBy("conv", "place", "level", "source").agg(F.count("*").alias("n"))
    # the shallowest level first, then votes, then the latest
    named = votes.groupBy("conv", "place").agg(F.max(F.struct(-F.col("level"), "n", "source"))["source"].alias("linked_to"))
    parents = messages.join(named, ["conv", "place"], "left").select("conv", "place", F.coalesce("linked_to", F.when(F.col("place") > 0, F.col("place") - 1)).alias("parent"), F.col("linked_to").isNotNull().alias("linked"))
    parents = materialise(parents, "parents")
    # depth by doubling: each step looks twice as far up
    state = parents.select("conv", "place", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    while state.filter("up IS NOT NULL").limit(1).count():
        above = state.select("conv", F.col("place").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        rising = state.filter("up IS NOT NULL").join(above, ["conv", "up"]).select("conv", "place", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        state = materialise(rising.unionByName(state.filter("up IS NULL")), "depths")
    said = messages.select("conv", F.col("place").alias("parent"), F.col("turn").alias("reply_to"))
    full = messages.join(parents, ["conv", "place"]).join(state.select("conv", "place", "depth"), ["conv", "place"]).join(said, ["conv", "parent"], "left")
    out = full.select("conv", "conv_id", "turn", "role", _body(F.col("text")).alias("body"), "reply_to", "linked", "depth", F.col("place").alias("said"))
    return sums_before(out, ["conv"], ["depth", "said"], {"place": F.lit(1)}, "places").select("conv_id", "turn", "role", "body", "reply_to", "linked", "depth", "place")


def oracle() -> str:
    """link_quotations in DuckDB SQL, where no two messages have one conversation, turn and text."""
    quote = r"^((?:[ \t]*>)+)"
    quoted = f"regexp_matches({{}}, '{quote}')"
    introduction = INTRODUCTION.replace(r"\s", r"[ \t\n\x0B\f\r]")
    return f"""
WITH RECURSIVE m AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS conv, turn, role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(text, '')) - 1 AS place FROM conversations),
r AS (SELECT conv, place, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM (SELECT conv, place, str_split(text, chr(10)) AS lines FROM m)),
l AS (
  SELECT conv, place, i, line, length(regexp_extract(line, '{quote}', 1)) - length(replace(regexp_extract(line, '{quote}', 1), '>', '')) AS level,
    lower(trim(regexp_replace(regexp_replace(line, '{quote}', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS body FROM r),
b AS (SELECT *, CASE WHEN body = '' OR coalesce(lag(body) OVER w, '') = '' OR lag(level) OVER w <> level THEN 1 ELSE 0 END AS cut FROM l WINDOW w AS (PARTITION BY conv, place ORDER BY i)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY conv, place ORDER BY i) AS run FROM b),
x AS (
  SELECT conv, place, level, body FROM l WHERE regexp_matches(body, '[\\p{{L}}\\p{{N}}]')
  UNION
  SELECT conv, place, level, body FROM (SELECT conv, place, level, string_agg(body, ' ' ORDER BY i) AS body FROM k WHERE body <> '' GROUP BY conv, place, level, run HAVING count(*) > 1) WHERE regexp_matches(body, '[\\p{{L}}\\p{{N}}]')),
links AS (SELECT q.conv, q.place, q.level, q.body, max(o.place) AS source FROM x q JOIN x o ON o.conv = q.conv AND o.body = q.body AND o.level = 0 AND o.place < q.place WHERE q.level > 0 GROUP BY ALL),
votes AS (SELECT conv, place, level, source, count(*) AS n FROM links GROUP BY ALL),
named AS (SELECT conv, place, source FROM votes QUALIFY row_number() OVER (PARTITION BY conv, place ORDER BY level, n DESC, source DESC) = 1),
parents AS (SELECT m.conv, m.place, coalesce(source, CASE WHEN m.place > 0 THEN m.place - 1 END) AS parent, source IS NOT NULL AS linked FROM m LEFT JOIN named USING (conv, place)),
depths AS (
  SELECT conv, place, 0::BIGINT AS depth FROM parents WHERE parent IS NULL
  UNION ALL
  SELECT p.conv, p.place, d.depth + 1 FROM parents p JOIN depths d ON d.conv = p.conv AND d.place = p.parent),
own AS (SELECT conv, place, i, line FROM (SELECT *, coalesce({quoted.format('lead(line) OVER (PARTITION BY conv, place ORDER BY i)')}, false) AS quotes FROM l) WHERE NOT {quoted.format('line')} AND NOT (regexp_matches(line, '{introduction}') AND quotes)),
bodies AS (SELECT conv, place, trim(string_agg(line, chr(10) ORDER BY i)) AS body FROM own GROUP BY ALL)
SELECT conv_id, turn, role, coalesce(body, '') AS body, said.turn_of AS reply_to, linked, depth, row_number() OVER (PARTITION BY m.conv ORDER BY depth, m.place) - 1 AS place
FROM m JOIN parents USING (conv, place) JOIN depths USING (conv, place) LEFT JOIN bodies USING (conv, place) LEFT JOIN (SELECT conv, place AS parent, turn AS turn_of FROM m) said ON said.conv = m.conv AND said.parent = parents.parent
"""
