"""Message checks: patterns in three classes, the first that matches decides. The patterns are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attempts to change the instructions, and questions beyond any knowledge base.
INJECTION = (
    r"ignore (all )?(previous|above) (instructions|directions|prompts)", r"system prompt", r"reveal (your|the) (instructions|system prompt|hidden prompt)",
    r"you are now (in )?(dan|jailbreak|developer|unrestricted) mode", r"bypass (all )?(guardrails|safety|filters)", r"act as an unrestricted", r"pretend you have no rules",
    r"repeat the words above", r"what was your initial instruction",
)
OFF_TOPIC = (
    r"who won the (world cup|ipl|olympics|fifa)", r"write (a|python|java|c\+\+|javascript) code to", r"recipe for", r"solve this math problem", r"who is the president of",
    r"tell me a joke about", r"write an essay on global warming",
)
#: A short default; a deployment brings its own list.
ABUSIVE = (r"\b(idiot|moron|imbecile|scumbag|loser)\b", r"\b(kill\s+yourself|go\s+die|hang\s+yourself)\b", r"\b(hack\s+into|ddos|leak\s+database|drop\s+database)\b")


def unmasked(message: Column) -> Column:
    """Letters for the signs that stand in for them."""
    return F.translate(message, "@$01!3*", "asoiie")


def collapsed(message: Column) -> Column:
    """Three or more of a character become two."""
    return F.regexp_replace(message, r"(.)\1{2,}", "$1$1")


def despaced(message: Column) -> Column:
    """Single separators between single letters dropped."""
    return F.regexp_replace(message, r"(?<=\b\w)[ ._\-](?=\w\b)", "")


def verdict(message: Column, abusive: tuple[str, ...] = ABUSIVE) -> Column:
    """``injection``, ``abusive``, ``off-topic`` or ``allowed``; a null message is allowed."""
    low = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    plain = unmasked(low)
    any_of = lambda text, patterns: reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))
    rude = any_of(low, abusive) | any_of(plain, abusive) | any_of(collapsed(plain), abusive) | any_of(despaced(plain), abusive)
    return F.when(any_of(low, INJECTION), "injection").when(rude, "abusive").when(any_of(low, OFF_TOPIC), "off-topic").otherwise("allowed")
