"""Evidence against chance, in bits, as column expressions: tails of counts, checks, priors and searches."""

from __future__ import annotations

from math import comb, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN2 = log(2.0)
#: A prior of any size takes away at most so many bits. Fixed value.
LEAST_PRIOR = -8.0


def poisson_tail_bits(k: Column, expected: Column) -> Column:
    """Bits of the Chernoff bound on k events or more where ``expected`` are due; 0 where no more came, or on odd numbers."""
    bits = (k * F.ln(k / expected) - (k - expected)) / LN2
    return F.when((expected > 0) & (k > expected) & (k < float("inf")), F.greatest(F.lit(0.0), bits)).otherwise(0.0)


def binomial_tail_bits(k: Column, trials: Column, p: float) -> Column:
    """The same for k successes or more of ``trials``, each by chance with probability p; all of them give log2(1/p) a trial."""
    p = max(p, 1e-300)
    if not p < 1:
        return F.lit(0.0)
    x = F.least(k / trials, F.lit(1.0))
    missed = F.when(x < 1, (1 - x) * F.ln((1 - x) / (1 - p))).otherwise(0.0)
    more = (trials > 0) & (trials < float("inf")) & (k > trials * p) & (k < float("inf"))
    return F.when(more, F.greatest(F.lit(0.0), trials * (x * F.ln(x / p) + missed) / LN2)).otherwise(0.0)


def chance_of_word(width: int, errors: int, either: bool = False) -> float:
    """Chance that random bits match a word (or its complement too) at one place with so many errors at most."""
    near = sum(comb(width, e) for e in range(min(errors, width) + 1))
    return min(1.0, (2 if either else 1) * near / 2**width)


def sync_bits(hits: Column, places: Column, width: int, errors: int, either: bool = False) -> Column:
    """Bits of finding a word so often, less its width, as any word of that width might have been found."""
    return F.greatest(F.lit(0.0), poisson_tail_bits(hits.cast("double"), places * chance_of_word(width, errors, either)) - width)


def check_bits(valid: Column, tested: Column, width: float) -> Column:
    """Bits of so many independent frames passing a check of ``width`` bits among those tested."""
    return binomial_tail_bits(valid.cast("double"), F.greatest(tested, valid).cast("double"), 2.0**-width) if width > 0 else F.lit(0.0)


def prior_bits(p: Column) -> Column:
    """Bits of a prior probability, never below ``LEAST_PRIOR``: it may put a hypothesis off, not away."""
    return F.when((p > 0) & (p < float("inf")), F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(0.0), F.log2(p)))).otherwise(LEAST_PRIOR)


def search_bits(hypotheses: Column) -> Column:
    """What having tried so many hypotheses costs."""
    return F.when(hypotheses > 1, F.log2(hypotheses)).otherwise(0.0)


def stage_bits(evidence: DataFrame, keys: list[str], group: str, bits: str, cap: float) -> DataFrame:
    """keys, n, bits: of each group of dependent measures the best counts once, groups add up to the cap at most."""
    best = evidence.groupBy(*keys, group).agg(F.max(bits).alias(bits), F.count("*").alias("n"))
    return best.groupBy(*keys).agg(F.sum("n").alias("n"), F.least(F.sum(bits), F.lit(cap)).alias(bits))
