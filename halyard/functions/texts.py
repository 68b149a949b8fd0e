"""Keys and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_key(a, b) -> Column:
    """The two ids in order, joined by a pipe."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def group_signature(members) -> Column:
    """SHA-256 of the canonical JSON of the (id, fingerprint) pairs of an array of structs, by id."""
    pairs = F.transform(F.array_sort(members), lambda m: F.concat(F.lit('["'), m["id"], F.lit('","'), m["fingerprint"], F.lit('"]')))
    return F.sha2(F.concat(F.lit('{"members":['), F.array_join(pairs, ","), F.lit("]}")), 256)


def holdout(group, seed: int = 170406) -> Column:
    """The fixed partition of a group id: a fifth is held out."""
    group = F.col(group) if isinstance(group, str) else group
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group), 256), 1, 8), 16, 10).cast("long")
    return F.when(number % 5 == 0, "holdout").otherwise("train")


def sequence_gap(left, right) -> Column:
    """Difference of the last numbers before the file extensions; null if either has none."""
    number = lambda c: F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(\d+)(?=\.[^.]+$)", 1).try_cast("long")
    return F.abs(number(left) - number(right))
