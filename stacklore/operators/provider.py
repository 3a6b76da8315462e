"""Replies of an outside model to a table of prompts, each prompt asked once.

A provider is any function from a list of prompts to a list of replies, null where a call
failed. It runs inside Arrow tasks on small batches. Replies are kept in a keyed log under
the hash of model and prompt, one commit per round: a later run, or another table with the
same prompts, asks only what has no reply yet, and a run that broke off goes on after its
last committed round. A task that Spark repeats may call the provider again for prompts of
the round in progress; only the replies of one attempt are committed.

Cases: a null prompt is never asked and has a null reply; an empty one is a prompt. Equal
prompts, however many, are asked once. A prompt that fails in all rounds keeps a null reply
and is asked again by the next run. Of an empty table nothing is asked. Columns of the
prompts are returned as they are, but for one called ``reply``, which is refused.
"""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stacklore.session import cut_lineage
from stacklore.streaming.keyed_log import KeyedLog

BATCH, TRIES = 32, 3


def prompt_key(prompt, model):
    """Column: what a reply is stored under."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), prompt), 256)


def reply_log(spark, path) -> KeyedLog:
    return KeyedLog(spark, path, {"replies": ["prompt_key"]})


def _called(batches, provider, size):
    for batch in batches:
        replies = []
        for at in range(0, len(batch), size):
            prompts = batch["prompt"].iloc[at:at + size].tolist()
            answers = list(provider(prompts))
            if len(answers) != len(prompts):
                raise ValueError("a provider gives one reply, or null, per prompt")
            replies += answers
        yield pd.DataFrame({"prompt_key": batch["prompt_key"],
                            "reply": pd.Series(replies, dtype=object, index=batch.index)})


def ask(prompts: DataFrame, provider, log: KeyedLog, model, batch=BATCH, tries=TRIES,
        tasks=None) -> DataFrame:
    """``prompts`` with the column ``reply``; ``prompt`` is the text to send.

    ``tasks`` bounds how many calls run side by side. Needs the whole table only as keys:
    texts of prompts that have a reply are neither shuffled nor sent.
    """
    if "reply" in prompts.columns:
        raise ValueError("prompts have a column reply already")
    key = prompt_key(F.col("prompt"), model)
    writer = f"ask-{model}"
    for _ in range(tries):
        known = log.read("replies")
        asked = prompts.where("prompt is not null").select(key.alias("prompt_key"), "prompt")
        if known is not None:
            asked = asked.join(known.select("prompt_key"), "prompt_key", "left_anti")
        # Equal prompts collapse before they are shuffled.
        asked = asked.dropDuplicates(["prompt_key"])
        if tasks:
            asked = asked.repartition(tasks)
        replies = cut_lineage(asked.mapInPandas(
            lambda batches: _called(batches, provider, batch),
            "prompt_key string, reply string"), "replies")
        counts = replies.agg(F.count("*").alias("asked"), F.count("reply").alias("answered")).first()
        if counts["answered"]:
            # Written before this line, so the commit and the count see the same replies.
            log.commit(writer, log.head()["writers"].get(writer, -1) + 1,
                       {"replies": replies.where("reply is not null")})
        if counts["asked"] == counts["answered"]:
            break
    known = log.read("replies")
    if known is None:
        return prompts.withColumn("reply", F.lit(None).cast("string"))
    stored = known.select(F.col("prompt_key").alias("_prompt_key"), "reply")
    return prompts.withColumn("_prompt_key", key).join(
        stored, "_prompt_key", "left").select(*prompts.columns, "reply")
