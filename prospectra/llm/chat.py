"""Chat formatting by perspective rotation, with DataFrame functions only.

Every participant of a dialogue gets a rendering of it in which that speaker is the assistant and
all others are named users; the masks say which characters are to be learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _user(role: Column) -> Column:
    """A name that no other role has: all but letters, digits and .-*_ is percent-encoded."""
    return F.concat(F.lit("user name="), F.url_encode(role))


def _piece(kind: Column, said: Column) -> Column:
    return F.concat(F.lit(OPEN), kind, F.lit("\n"), said, F.lit(CLOSE + "\n"))


def perspectives(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system", part_turns: int | None = None
) -> DataFrame:
    """One row per conversation and speaker, each of the whole dialogue.

    Columns: the conversation, speaker, part (long), n_messages, n_own (long), rendered, spans
    (array of struct<start, stop>: what the model learns, in characters of `rendered`, each of the
    speaker's texts with its end marker) and n_learned.

    Messages are in order of turn, null first; equal turns are in order of a hash of their content,
    and wholly equal rows count once. A null role is the user "unknown", a null text empty; `system`
    messages stand in every rendering and have none of their own, so a conversation of these alone
    gives no rows. Markers inside texts are broken by a backslash. A message without a conversation
    is one of its own. With `part_turns`, a dialogue comes in parts of that many turn numbers, and
    its system messages stand in each; part is then the turn divided by it, else 0. Other columns
    are not read. An empty table gives no rows.
    """
    who = F.coalesce(F.col(role).cast("string"), F.lit("unknown"))
    said = F.replace(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(OPEN), F.lit("<|\\im_start|>")), F.lit(CLOSE), F.lit("<|\\im_end|>"))
    rows = df.select(F.col(conversation).alias("__c"), F.col(turn).alias("turn"), who.alias("role"), said.alias("said")).distinct()
    rows = rows.withColumn("h", F.xxhash64("turn", "role", "said")).withColumn("alone", F.when(F.col("__c").isNull(), F.col("h")))
    part = F.lit(0) if part_turns is None else F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1))
    rows = rows.withColumn("part", part.cast("long"))
    if part_turns is not None:
        talk, rules = rows.where(F.col("role") != system), rows.where(F.col("role") == system)
        places = talk.where("alone is null").select(F.col("__c").alias("__d"), F.col("part").alias("__p")).distinct()
        rows = talk.unionByName(rules.join(places, F.col("__c") == F.col("__d")).withColumn("part", F.col("__p")).drop("__d", "__p"))
    # Characters up to each message's end, were all speakers named users.
    named = F.length(_piece(F.when(F.col("role") == system, F.lit("system")).otherwise(_user(F.col("role"))), F.col("said"))).cast("long")
    along = Window.partitionBy("__c", "alone", "part").orderBy("turn", "h", "role", "said").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    measured = rows.withColumn("upto", F.sum(named).over(along))
    whole = measured.groupBy("__c", "alone", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "role", "said", "upto"))).alias("m"))
    speakers = F.array_distinct(F.filter(F.transform("m", lambda x: x["role"]), lambda r: r != system))
    both = whole.withColumn("speaker", F.explode(speakers))
    speaker = F.col("speaker")
    kind = lambda x: F.when(x["role"] == system, F.lit("system")).when(x["role"] == speaker, F.lit("assistant")).otherwise(_user(x["role"]))
    # Each of the speaker's messages up to here is shorter by the difference of the two heads.
    shorter = (F.length(_user(speaker)) - len("assistant")).cast("long")
    own = F.filter("m", lambda x: x["role"] == speaker)
    stop = lambda x, i: x["upto"] - (i + 1) * shorter - 1
    spans = F.transform(own, lambda x, i: F.struct((stop(x, i) - len(CLOSE) - F.length(x["said"])).alias("start"), stop(x, i).alias("stop")))
    return both.withColumn("spans", spans).select(
        F.col("__c").alias(conversation),
        "speaker",
        "part",
        F.size("m").cast("long").alias("n_messages"),
        F.size("spans").cast("long").alias("n_own"),
        F.array_join(F.transform("m", lambda x: _piece(kind(x), x["said"])), "").alias("rendered"),
        "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_learned"),
    )
