"""Dealing rows into buckets of consecutive keys, by bounds that are fixed before the shuffle.

A range partitioner samples anew in every job, and Window without a partition gathers all
rows in one task. Here approximate quantiles of the key are computed once, over the key
column alone, and become literals: a row's bucket is then a plain expression, the same in
every job and on every retry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Bounds the literals in a plan and what the driver holds; more buckets come by equal steps between the bounds.
MOST_BOUNDS = 4096


@dataclass(frozen=True)
class Buckets:
    """Ascending lower bounds of buckets 1, 2, ...; rows below the first, and nulls, are in 0."""

    bounds: list[int]
    smallest: int | None
    largest: int | None
    #: Equal steps of the key into which each range between bounds falls in turn.
    steps: int = 1

    @property
    def number(self) -> int:
        return (len(self.bounds) + 1) * self.steps

    def column(self, key: str) -> Column:
        """The bucket of a row: a binary search in the bounds, then a step between them; null keys in 0."""
        if self.smallest is None or self.largest is None:
            return F.lit(0).cast("bigint")
        ends = [self.smallest, *self.bounds, self.largest + 1]

        def step(i: int) -> Column:
            if self.steps == 1:
                return F.lit(i).cast("bigint")
            low, wide = ends[i], max(1, ends[i + 1] - ends[i])
            # the difference is taken as a decimal: it may not fit in a long
            at = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double") * F.lit(self.steps / wide))
            at = F.coalesce(at.cast("bigint"), F.lit(0).cast("bigint"))
            return F.greatest(F.least(at, F.lit(self.steps - 1)), F.lit(0)) + F.lit(i * self.steps).cast("bigint")

        def search(first: int, last: int) -> Column:
            """A balanced tree of comparisons over the ranges first to last."""
            if first == last:
                return step(first)
            mid = (first + last + 1) // 2
            return F.when(F.col(key) >= self.bounds[mid - 1], search(mid, last)).otherwise(search(first, mid - 1))

        return search(0, len(self.bounds))


def order_buckets(docs: DataFrame, key: str, bucket_bytes: int, least: int = 1, in_steps: bool = True) -> Buckets:
    """Buckets of ``key`` with about ``bucket_bytes`` of text each.

    Bounds are keys that occur. Equal keys share a bucket; a key is expected to be nearly
    unique. Beyond ``MOST_BOUNDS`` buckets each range between two bounds is cut into equal
    steps of the key (unless ``in_steps`` is off), so buckets do not grow with the corpus as
    long as keys lie evenly inside a range of 1 / ``MOST_BOUNDS`` of the rows.
    """
    size = docs.agg(F.sum(F.octet_length("text") + 16).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if size.hi is None:
        return Buckets([], None, None)
    wanted = max(least, -(-int(size.n or 0) // bucket_bytes))
    number = min(MOST_BOUNDS, wanted)
    if number < 2:
        return Buckets([], size.lo, size.hi)
    cuts = docs.agg(F.percentile_approx(key, [i / number for i in range(1, number)], max(10_000, 10 * number))).first()[0]
    return Buckets(sorted({int(c) for c in cuts if c > size.lo}), size.lo, size.hi, -(-wanted // number) if in_steps else 1)
