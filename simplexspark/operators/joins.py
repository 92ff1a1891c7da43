"""Key joins. Mostly no hint is given: table statistics and adaptive execution broadcast a side
only when its measured size is below the session threshold, and split skewed partitions
otherwise. A stage's files are packed, though: where a table grows, or is opened up after it was
read, its rows may take forty times their files, and ``by_shuffle`` keeps them off the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side that no join may broadcast, however small its files are."""
    return df.hint("merge")


def expand_to_members(facts: DataFrame, membership: DataFrame, group: str, member: str) -> DataFrame:
    """Copy each group's facts to all its members; facts of a group without members stay
    with a null member. Membership pairs are made distinct first, so the fan-out is exactly
    the group's size."""
    return facts.join(membership.select(group, member).distinct(), group, "left")


def lookup_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]],
                carry: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on differently named keys, keeping the left names and the carried columns."""
    keyed = right.select(*[F.col(r).alias(f"__k{i}") for i, (_, r) in enumerate(pairs)], *carry)
    on = None
    for i, (l, _) in enumerate(pairs):
        c = left[l] == keyed[f"__k{i}"]
        on = c if on is None else on & c
    return left.join(keyed, on, how).select(*[left[c] for c in left.columns], *[keyed[c] for c in carry])


def exclude(df: DataFrame, excluded: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not excluded. Rows with a null key stay, unlike ``~isin``."""
    return df.join(excluded.select(*key), list(key), "left_anti")


def merge_conflicts(df: DataFrame, key: Sequence[str], donor: Column, target: Column, part: str,
                    order: Sequence[str]) -> DataFrame:
    """Overwrite ``part`` of target rows from the donor row with the same key, then delete
    the donors. A donor's null also overwrites. Of several donors for a key the last by
    ``order`` wins."""
    is_donor, is_target = F.coalesce(donor, F.lit(False)), F.coalesce(target, F.lit(False))
    donors = (df.filter(is_donor).groupBy(*key)
              .agg(F.max_by(F.struct(F.col(part).alias("v")), F.struct(*order)).alias("__donor")))
    kept = df.filter(~is_donor)
    hit = is_target & F.col("__donor").isNotNull()
    return (kept.join(donors, list(key), "left")
            .withColumn(part, F.when(hit, F.col("__donor.v")).otherwise(F.col(part)))
            .select(*df.columns))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys in which null meets null, keeping the left key columns."""
    named = right.withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return left.join(named, on, how).drop(*[f"__j{i}" for i in range(len(keys))])
