"""Small reusable column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(num, den, digits: int) -> Column:
    """round(100 * num / den, digits); NULL instead of an ANSI error when den = 0.

    The multiplication comes first, as in ``100.0 * a / b``, so that the
    rounding boundary cases equal the SQL form.
    """
    num, den = col_or_name(num), col_or_name(den)
    return F.round(F.lit(100.0) * num / F.nullif(den, F.lit(0)), digits)


def safe_div(num, den) -> Column:
    num, den = col_or_name(num), col_or_name(den)
    return num / F.nullif(den, F.lit(0))


def hash_bucket(key, salt: str, buckets: int = 10000) -> Column:
    """Deterministic bucket in [0, buckets) from md5(salt ':' key).

    First 8 hex digits of the digest as an unsigned 32-bit number, modulo
    ``buckets``. Pure column expression: no shuffle, stable across runs,
    engines and partitionings.
    """
    digest = F.md5(F.concat(F.lit(salt), F.lit(":"), col_or_name(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def cumulative_cuts(weights: Iterable[tuple[str, float]], buckets: int = 10000):
    """(value, upper bucket bound) pairs from (value, weight) pairs."""
    pairs = list(weights)
    total = sum(w for _, w in pairs)
    cuts, acc = [], 0.0
    for value, w in pairs:
        acc += w
        cuts.append((value, int(round(acc / total * buckets))))
    return cuts


def weighted_choice(key, salt: str, weights: Iterable[tuple[str, float]], buckets: int = 10000) -> Column:
    """Assign each key one of the values with the given weights (hash based)."""
    b = hash_bucket(key, salt, buckets)
    cuts = cumulative_cuts(weights, buckets)
    expr = None
    for value, bound in cuts[:-1]:
        expr = F.when(b < bound, F.lit(value)) if expr is None else expr.when(b < bound, F.lit(value))
    last = F.lit(cuts[-1][0])
    return last if expr is None else expr.otherwise(last)


def map_lookup(c, mapping: Mapping[str, str], passthrough: bool = True) -> Column:
    """Literal dictionary lookup as a map expression (no join)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    looked = F.try_element_at(m, col_or_name(c))
    return F.coalesce(looked, col_or_name(c)) if passthrough else looked
