"""Column functions over arrays of logits, tokens and labels (P1-P7); all of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 1e-7  # probabilities below it count as it in a KL divergence
SCORE_EDGES = tuple(i * 0.2 for i in range(1, 25))


def relabel_cyclic(label: Column, n: int = 3) -> Column:
    """(label + 1) mod n."""
    return F.pmod(label + 1, F.lit(n))


def encode_label(label: Column, labels: Sequence[str]) -> Column:
    """The position of a label string in ``labels``; null stays null, an unknown label is an error."""
    at = F.array_position(F.array(*map(F.lit, labels)), label).cast("int") - 1
    return F.when(label.isNull(), None).when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("int"))


def bin_score(score: Column, edges: Sequence[float] = SCORE_EDGES, low: float = 0.0, high: float = 5.0) -> Column:
    """The number of ``edges`` at or below the score; scores outside [low, high] are an error."""
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= score))
    return F.when(score.isNull(), None).when((score >= low) & (score <= high), below).otherwise(F.raise_error(F.lit("score out of range")).cast("int"))


def pad_tokens(tokens: Column, length: int, pad: int = 0) -> Column:
    """The first ``length`` tokens, filled up with ``pad`` on the right."""
    kept = F.slice(tokens, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad).cast("int"), F.lit(length) - F.size(kept)))


def trim_batch(rows: DataFrame, batch: str, mask: str, arrays: Sequence[str]) -> DataFrame:
    """``rows`` whose ``arrays`` keep only the positions at which some row of the batch has mask 1. Masks are packed, 64 positions a long, so that a
    row of the table sends one row for 64 tokens, and combined in the tasks first."""
    packed = f"transform(sequence(0, greatest(size({mask}) - 1, 0) div 64), w -> aggregate(slice({mask}, w * 64 + 1, 64), struct(0L AS bits, 0 AS i), (s, m) -> struct(s.bits | IF(m = 1, shiftleft(1L, s.i), 0L) AS bits, s.i + 1 AS i), s -> s.bits))"
    words = rows.select(batch, F.posexplode(F.expr(packed)).alias("w", "bits")).where("bits <> 0").groupBy(batch, "w").agg(F.bit_or("bits").alias("bits"))
    kept = words.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("words_"))
    places = "flatten(transform(words_, c -> transform(filter(sequence(0, 63), i -> getbit(c.bits, i) = 1), i -> c.w * 64 + i)))"
    joined = rows.join(kept.select(batch, F.expr(places).alias("kept_")), batch, "left").withColumn("kept_", F.coalesce("kept_", F.array().cast("array<int>")))
    return joined.withColumns({a: F.expr(f"transform(kept_, p -> element_at(`{a}`, p + 1))") for a in arrays}).drop("kept_")


def logsumexp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_softmax(logits: Column) -> Column:
    whole = logsumexp(logits)
    return F.transform(logits, lambda x: x - whole)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    whole = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(logits, lambda x: F.exp(x - top) / whole)


def argmax(values: Column) -> Column:
    """The position of the largest value; the first one of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    return logsumexp(logits) - F.element_at(logits, label + 1)


def kl(new: Column, old: Column) -> Column:
    """KL(softmax(new), softmax(old)), both clipped to [CLIP, 1]."""
    clip = lambda p: F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0))
    terms = F.zip_with(softmax(new), softmax(old), lambda p, q: clip(p) * F.log(clip(p) / clip(q)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def vector_sum(column: str | Column, size: int) -> Column:
    """An aggregate: the sum of arrays of ``size`` doubles, position by position."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array(*(F.sum(c[k]) for k in range(size)))
