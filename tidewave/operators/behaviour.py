"""Behaviour: bouts, wheels, cues and rewards, directions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.timeline import as_of, window_join


def bout_onsets(df: DataFrame, pause: int, shortest: int, longest: int) -> DataFrame:
    """Events after a pause of more than so many ticks whose next event comes within an open range of ticks."""
    w = Window.partitionBy("unit").orderBy("t")
    return df.withColumn("_b", F.col("t") - F.lag("t").over(w)).withColumn("_a", F.lead("t").over(w) - F.col("t")).filter((F.coalesce("_b", F.lit(pause + 1)) > pause) & (F.col("_a") > shortest) & (F.col("_a") < longest)).drop("_b", "_a")


def rotary_ticks(samples: DataFrame) -> DataFrame:
    """unit, t, step: signed steps of two square waves a and b in quadrature. samples(unit, t, a, b of 0 and 1)."""
    w = Window.partitionBy("unit").orderBy("t")
    place = F.when(F.col("a") == 0, F.when(F.col("b") == 0, 0).otherwise(3)).otherwise(F.when(F.col("b") == 0, 1).otherwise(2))
    moved = samples.withColumn("_p", place).withColumn("_d", F.pmod(F.col("_p") - F.lag("_p").over(w), F.lit(4)))
    return moved.withColumn("step", F.when(F.col("_d") == 1, 1).when(F.col("_d") == 3, -1)).filter("step IS NOT NULL").select("unit", "t", "step")


def cued_rewards(rewards: DataFrame, cues: DataFrame, licks: DataFrame, span: int) -> DataFrame:
    """unit, id, t, cue, lick of rewards with a cue less than span before (the first) and a lick less than span after (the first)."""
    r = rewards.select("unit", "id", "t")
    events = r.withColumnRenamed("t", "event")
    before = window_join(events, cues.select("unit", "t"), -span + 1, -1, ["unit"]).groupBy("unit", "id").agg(F.min("t").alias("cue"))
    after = window_join(events, licks.select("unit", "t"), 1, span - 1, ["unit"]).groupBy("unit", "id").agg(F.min("t").alias("lick"))
    return r.join(before, ["unit", "id"]).join(after, ["unit", "id"])


def lone(events: DataFrame, used: DataFrame) -> DataFrame:
    """Events that no trial has used."""
    return events.join(used.select("unit", "t"), ["unit", "t"], "left_anti")


def trial_rewards(offsets: DataFrame, rewards: DataFrame, longest: int) -> DataFrame:
    """unit, id, t, reward: the first reward at or after each trial's end, less than so many ticks later; null without."""
    d = as_of(offsets.select("unit", "t", "id"), rewards.select("unit", "t"))
    return d.select("unit", "id", "t", F.when(F.col("next") - F.col("t") < longest, F.col("next")).alias("reward"))


def preferred_direction(rates: DataFrame) -> DataFrame:
    """unit, direction (radians from 0 to 2 pi), selectivity of rates(unit, angle, rate): the vector sum over the sum."""
    x, y = F.sum(F.col("rate") * F.cos("angle")), F.sum(F.col("rate") * F.sin("angle"))
    return rates.groupBy("unit").agg(F.pmod(F.atan2(y, x), F.lit(2 * math.pi)).alias("direction"), (F.hypot(x, y) / F.sum("rate")).alias("selectivity"))


def frame_of(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """session, frame, video, at: which video holds a frame of a session whose videos follow each other. frames(session, frame), videos(session, video, frames, place)."""
    w = Window.partitionBy("session").orderBy("place")
    starts = videos.filter("frames > 0").withColumn("stop", F.sum("frames").over(w)).withColumn("start", F.col("stop") - F.col("frames"))
    found = as_of(frames.select("session", "frame"), starts.select("session", F.col("start").alias("frame")), ["session"], "frame")
    held = found.join(starts.select("session", F.col("start").alias("previous"), "stop", "video"), ["session", "previous"])
    return held.filter("frame < stop").select("session", "frame", "video", (F.col("frame") - F.col("previous")).alias("at"))


def threshold_events(signal: DataFrame, share: float = 0.2) -> DataFrame:
    """channel, i, edge (1 on, -1 off) of an analogue signal(channel, i, v) at its first percentile and a share of the way to its maximum."""
    th = signal.groupBy("channel").agg(F.percentile("v", F.lit(0.01)).alias("_lo"), F.max("v").alias("_hi")).select("channel", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("_th"))
    w = Window.partitionBy("channel").orderBy("i")
    on = signal.join(th, "channel").withColumn("_on", (F.col("v") >= F.col("_th")).cast("int"))
    return on.withColumn("edge", F.col("_on") - F.lag("_on").over(w)).filter("edge <> 0").select("channel", "i", "edge")
