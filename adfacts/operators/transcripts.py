"""Reading agent chats: one row per message, ``idx`` is its place from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions.text import strip, text_or_empty

END = "END"


def _first_held(content: Column, tests: list[tuple[str, str]], otherwise: str) -> Column:
    chain = F
    for held, outcome in tests:
        chain = chain.when(F.contains(content, F.lit(held)), F.lit(outcome))
    return chain.otherwise(F.lit(otherwise))


def next_speaker(name: Column, content: Column) -> Column:
    """Who speaks next where the user's marker names the agent."""
    return (
        F.when(name == "User", _first_held(content, K.AGENT_MARKERS, END))
        .when(name.isin(K.AGENTS), F.lit("Critic"))
        .when(name == "Critic", _first_held(content, [("TERMINATE", END), *K.MENTIONS], END))
        .otherwise(F.lit(END))
    )


def next_speaker_planned(idx: Column, name: Column, content: Column) -> Column:
    """Who speaks next where a planner names the agent."""
    return (
        F.when(idx == 0, F.lit("Planner"))
        .when(name == "Planner", _first_held(content, K.PLANS, "Critic"))
        .when(name.isin(K.AGENTS), F.lit("Critic"))
        .when(name == "Critic", _first_held(content, [("TERMINATE", END), *K.MENTIONS], "Planner"))
        .otherwise(F.lit(END))
    )


def speaker_audit(messages: DataFrame, planned: bool = False) -> DataFrame:
    """Each message with the next speaker by the rule and the one who spoke.

    The next message is the one with the next higher place, whatever the gap. Chats end after a
    few rounds by rule, so one is never large.
    """
    content = text_or_empty(F.col("content"))
    rule = (
        next_speaker_planned(F.col("idx"), F.col("name"), content)
        if planned
        else next_speaker(F.col("name"), content)
    )
    following = F.lead("name", 1, END).over(Window.partitionBy("conv_id").orderBy("idx"))
    return (
        messages.select("conv_id", "idx", "name", rule.alias("expected_next"))
        .withColumn("actual_next", following)
        .withColumn("as_expected", F.col("expected_next") == F.col("actual_next"))
    )


def _chats(messages: DataFrame) -> DataFrame:
    """Per chat its rounds, whether it was closed, and the final answer, by one shuffle.

    Each message learns the closing place and the task of its chat; the last message of the agent
    before that place is a maximum then, so no chat's texts are gathered.
    """
    idx = F.col("idx")
    content = text_or_empty(F.col("content"))
    closing = (F.col("name") == "Critic") & F.contains(content, F.lit("TERMINATE"))
    task = F
    for number, (marker, _) in enumerate(K.AGENT_MARKERS):
        task = task.when(F.contains(content, F.lit(marker)), F.lit(number))
    agents = F.array(*[F.lit(agent) for _, agent in K.AGENT_MARKERS])
    chat = Window.partitionBy("conv_id")
    known = messages.select(
        "conv_id", "idx", "name", "content",
        F.max(F.when(closing, idx)).over(chat).alias("_closed"),
        F.get(agents, F.max(F.when(idx == 0, task)).over(chat)).alias("_agent"),
    )
    before = (F.col("name") == F.col("_agent")) & (idx < F.col("_closed"))
    last = F.max(F.when(before, F.struct("idx", "content")))["content"]
    return known.groupBy("conv_id").agg(
        (F.max(idx) + 1).alias("rounds"),
        F.coalesce(strip(last), F.lit("Unknown")).alias("answer"),
        F.max("_closed").isNotNull().alias("closed"),
    )


def final_answers(messages: DataFrame) -> DataFrame:
    """Per chat the agent's last message before the critic's last TERMINATE, else Unknown."""
    return _chats(messages).drop("rounds")


def rounds_used(messages: DataFrame, max_round: int) -> DataFrame:
    """Messages per chat and whether it ran into the cap without an answer."""
    hit_cap = (F.col("rounds") >= max_round) & (F.col("answer") == "Unknown")
    return _chats(messages).select("conv_id", "rounds", hit_cap.alias("hit_cap"))
