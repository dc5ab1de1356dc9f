"""Synthetic training mail, deterministic by seed and row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.functions.hashing import bucket

SPAM = [
    "You won {amount} dollars in our draw, confirm your details within {days} days!",
    "Final reminder: your mailbox is locked, sign in now to restore access.",
    "A new {item} is waiting for you at no cost, collect it today!",
    "Take {percent}% off every order, only until midnight.",
    "Earn {amount} per week from your sofa, no experience needed!",
    "Dear customer, unusual activity was found, verify your identity.",
    "Your parcel with the {item} is on hold, pay the fee to release it.",
    "Lucky visitor number {amount}! Claim your prize immediately.",
    "Cheap {item} offers, prices cut by {percent}%!!!",
    "Turn {amount} into ten times as much within {days} days, guaranteed.",
    "Approved: a loan of {amount} without any credit check.",
    "Last notice: your subscription expired, update your card.",
    "Be the first to test the latest {item} for free.",
    "Unclaimed inheritance of {amount} in your name, reply in confidence.",
    "Lose weight in {days} days with this secret recipe.",
    "Gift card worth {amount}, one click and it is yours!",
    "Security alert: someone used your password, act now.",
    "Double your savings, {percent}% interest every month.",
    "Members only: luxury {item} for a fraction of the price.",
    "Congratulations {name}, you are today's winner of a {item}!",
]
HAM = [
    "Hello {name}, are we still meeting at noon?",
    "The minutes of yesterday's call are in the shared folder.",
    "Could you look over the draft before Thursday, {name}?",
    "The build is green again after the fix from this morning.",
    "I will be on leave for {days} days, {name} covers for me.",
    "Thanks for lending me your {item} at the weekend.",
    "The invoice over {amount} was paid last Monday.",
    "Our tests now cover {percent}% of the code.",
    "Lunch at the new place around the corner, {name}?",
    "Please send me the slides for the customer visit.",
    "The lift is out of order, please take the stairs.",
    "Here is the agenda for the planning session.",
    "Could we move our appointment to next week?",
    "The library wants the book back within {days} days.",
    "I have attached the figures for the last quarter.",
    "Happy birthday, {name}, see you at the party!",
    "The printer on the second floor works again.",
    "{name} will join our team at the start of the month.",
    "Remember to enter your hours before Friday evening.",
    "The meeting room now has a {item} for presentations.",
]
NAMES = ["Ada", "Bela", "Chris", "Dana", "Eli", "Kim", "Noor", "Toni"]
ITEMS = ["bicycle", "projector", "phone", "camera", "tablet", "watch", "scooter", "speaker"]


def _pick(values: list[str], seed: str, key: str) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (bucket(seed, key, size=len(values)) + 1).cast("int"))


def _number(seed: str, key: str, low: int, high: int) -> Column:
    return (bucket(seed, key, size=high - low + 1) + low).cast("string")


def corpus(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One message per key, even keys spam and odd keys ham: ``key, text, label``."""
    is_spam = F.col(key) % 2 == 0
    text = F.when(is_spam, _pick(SPAM, f"{seed}.spam", key)).otherwise(_pick(HAM, f"{seed}.ham", key))
    fills = {
        "{name}": _pick(NAMES, f"{seed}.name", key), "{item}": _pick(ITEMS, f"{seed}.item", key),
        "{amount}": _number(f"{seed}.amount", key, 50, 50000), "{percent}": _number(f"{seed}.percent", key, 5, 80),
        "{days}": _number(f"{seed}.days", key, 3, 30)}
    for mark, value in fills.items():
        text = F.replace(text, F.lit(mark), value)
    return keys.select(key, text.alias("text"), F.when(is_spam, "spam").otherwise("ham").alias("label"))


def sample_dataset(spark: SparkSession, path: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Write ``n`` messages, half of them spam, as CSV and return them."""
    rows = corpus(spark.range(n // 2 * 2), "id", seed).select("text", "label")
    rows.write.mode("overwrite").option("header", True).csv(path)
    return rows
