"""Ordered rule lists compiled to one Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``category`` may hold ``{match}``, filled with the first capture group."""

    pattern: str
    category: str
    entity: str | None = None


HIT = "struct<category:string,confidence:int,entity_detected:string,reasoning:string,action:string>"


def hit(
    rules: Sequence[Rule],
    subject: Column,
    confidence: int,
    reason: Callable[[Column], Column],
    anchored: bool = False,
) -> Column:
    """Struct of the first matching rule, NULL when none matches.

    ``reason`` maps the pattern that matched to the reasoning text. The regex
    chain only picks the rule's position; the struct is looked up from it, so
    long rule lists stay one small expression.
    """
    if not rules:
        return F.lit(None).cast(HIT)
    wrap = (lambda p: f"(?i)^(?:{p})") if anchored else (lambda p: f"(?i){p}")
    texts = lambda values: F.array(*[F.lit(v).cast("string") for v in values])

    position = None
    for i, rule in enumerate(rules):
        test = subject.rlike(wrap(rule.pattern))
        position = F.when(test, i) if position is None else position.when(test, i)

    heads = texts([r.category.split("{match}")[0] for r in rules])
    tails = texts([r.category.split("{match}")[-1] if "{match}" in r.category else "" for r in rules])
    names = texts([r.entity for r in rules])
    patterns = texts([r.pattern for r in rules])

    def build(i: Column) -> Column:
        captured = None
        for k, rule in enumerate(rules):
            if "{match}" in rule.category:
                value = F.regexp_extract(subject, wrap(rule.pattern), 1)
                captured = F.when(i == k, value) if captured is None else captured.when(i == k, value)
        captured = F.lit(None).cast("string") if captured is None else captured
        return F.when(
            i.isNotNull(),
            F.struct(
                F.concat(F.get(heads, i), F.coalesce(captured, F.lit("")), F.get(tails, i)).alias("category"),
                F.lit(confidence).alias("confidence"),
                F.coalesce(captured, F.get(names, i)).alias("entity_detected"),
                reason(F.get(patterns, i)).alias("reasoning"),
                F.lit("move").alias("action"),
            ),
        )

    return F.get(F.transform(F.array(position), build), F.lit(0))
