"""Conversations: recent history, follow-ups, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import query as Q

RECENT, MOST_REPLY = 4, 250


def turns(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, turn, role, text) with what came before each: the
    last four newest first, the last thing the user said, whether anything did."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    recent = F.reverse(F.collect_list(F.coalesce("text", F.lit(""))).over(own.rowsBetween(-RECENT, -1)))
    return messages.withColumns({"recent": recent, "last_user": said, "has_history": F.row_number().over(own) > 1})


def history_window(messages: DataFrame) -> DataFrame:
    """The last four messages of each conversation as a prompt takes them."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    assistant = F.col("role") == "assistant"
    text = F.coalesce("text", F.lit(""))
    cut = F.when(assistant & (F.length(text) > MOST_REPLY), F.concat(F.substring(text, 1, MOST_REPLY), F.lit("..."))).otherwise(text)
    rows = messages.withColumn("back", place).where(F.col("back") <= RECENT)
    return rows.select("conv_id", "turn", F.when(assistant, "assistant").otherwise("user").alias("role"), cut.alias("content"))


def labelled(messages: DataFrame) -> DataFrame:
    """The user's turns with intent, branch, guardrail and the resolved query."""
    rows = turns(messages).where("role = 'user'")
    rows = rows.withColumn("intent", Q.intent(F.coalesce("text", F.lit("")), F.col("last_user"), F.col("has_history")))
    rows = rows.withColumn("follow", Q.resolved(F.col("text"), F.col("recent")))
    return rows.select("conv_id", "turn", "text", "has_history", "intent", Q.branch(F.col("intent")).alias("branch"), Q.guardrail(F.col("text")).alias("guarded"), F.col("follow.text").alias("resolved"), F.col("follow.was_resolved").alias("was_resolved"))


#: what each kind of assistant does, in our words
ROLES = {
    "shopping_assistant": "the shopping assistant of @: you help to find, compare and choose products and tell what they cost",
    "customer_support": "the customer support of @: you help with orders, rules, opening hours and services",
    "lead_generation": "the sales contact of @: you answer what is asked about the offer and help people to get in touch",
    "technical_support": "the technical support of @: you help to find faults and to follow instructions step by step",
    "general_assistant": "the assistant of @: you answer questions about the business, its offer and its site",
}


def duty(role: Column, name: Column) -> Column:
    """The text of a known role, any other role as it is, the general one for none."""
    said = F.coalesce(*(F.when(role == k, F.lit(v)) for k, v in ROLES.items()), F.nullif(F.trim(role), F.lit("")), F.lit(ROLES["general_assistant"]))
    return F.replace(said, F.lit("@"), name)


def system_prompt(custom: Column, role: Column, business: Column, summary: Column, site: Column, context: Column) -> Column:
    """The bot's own prompt if it has more than 20 characters, else one made of
    its role, name and summary; the context follows either."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(blank(business), F.lit("our website"))
    more = F.coalesce(F.concat(F.lit(" See "), blank(site), F.lit(" for anything else.")), F.lit(""))
    made = F.concat(F.lit("You are "), duty(role, name), F.lit(". Answer from the context alone, name only links found in it, and say so when it has no answer."), more, F.coalesce(F.concat(F.lit("\n\nBUSINESS:\n"), blank(summary)), F.lit("")))
    own = F.when(F.length(F.trim(custom)) > 20, F.trim(custom))
    return F.concat(F.coalesce(own, made), F.lit("\n\nCONTEXT:\n"), F.coalesce(blank(context), F.lit("No context available.")))
