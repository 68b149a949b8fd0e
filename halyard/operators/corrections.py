"""Manual edits as tables: overrides of events, blocked pairs and suppressed groups. Every edit returns new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .incremental import upsert


def _check(found: DataFrame, message: str) -> None:
    if found.limit(1).count():
        raise ValueError(message)


def move(overrides: DataFrame, members: DataFrame, event_id: str | None) -> DataFrame:
    """members (id, fingerprint) belong to event_id from now on; null takes them out of events."""
    return upsert(overrides, members.select("id", "fingerprint", F.lit(event_id).cast("string").alias("event_id")), ["id"])


def merge(overrides: DataFrame, assigned: DataFrame, events: list[str], into: str) -> DataFrame:
    """All members of `events` move to the event `into`. assigned: id, fingerprint, event_id."""
    if len(set(events)) < 2:
        raise ValueError("a merge needs two events")
    names = assigned.sparkSession.createDataFrame([(e,) for e in sorted(set(events))], "event_id string")
    _check(names.join(assigned, "event_id", "left_anti"), "an event to merge does not exist")
    return move(overrides, assigned.where(F.col("event_id").isin(*events)), into)


def split(overrides: DataFrame, assigned: DataFrame, event: str, members: DataFrame, into: str) -> DataFrame:
    """Some, and not all, members of an event move to a new one; the rest stay, from now on by hand."""
    own = assigned.where(F.col("event_id") == event)
    _check(members.select("id").join(own, "id", "left_anti"), "a member to split off is not in the event")
    rest = own.join(members.select("id"), "id", "left_anti")
    if not rest.limit(1).count() or not members.limit(1).count():
        raise ValueError("a split needs a proper part of the event")
    return move(move(overrides, rest, event), own.join(members.select("id"), "id", "left_semi"), into)


def rename(overrides: DataFrame, names: DataFrame, assigned: DataFrame, event: str, name: str, into: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The event's members stay together by hand, as `into` (or under its own id), whose name is set.

    names: event_id, name. Returns the new overrides and names. Names have 1 to 120 characters without the blanks around them.
    """
    name, into = name.strip(), into or event
    if not 1 <= len(name) <= 120:
        raise ValueError("an event's name has 1 to 120 characters")
    own = assigned.where(F.col("event_id") == event)
    if not own.limit(1).count():
        raise ValueError("the event to rename does not exist")
    fresh = assigned.sparkSession.createDataFrame([(into, name)], "event_id string, name string")
    return move(overrides, own, into), upsert(names, fresh, ["event_id"])


def remove(overrides: DataFrame, assigned: DataFrame, members: DataFrame) -> DataFrame:
    """Members (id) leave their events; what is left of those stays together by hand."""
    if not members.limit(1).count():
        raise ValueError("no members to remove")
    _check(members.select("id").join(assigned, "id", "left_anti"), "a member to remove does not exist")
    gone = assigned.join(members.select("id"), "id", "left_semi")
    rest = assigned.join(gone.where(F.col("event_id").isNotNull()).select("event_id").distinct(), "event_id", "left_semi").join(members.select("id"), "id", "left_anti")
    kept = upsert(overrides, rest.select("id", "fingerprint", "event_id"), ["id"])
    return move(kept, gone, None)


def block(blocked: DataFrame, group: DataFrame, member: str) -> DataFrame:
    """blocked (a, b, a_fingerprint, b_fingerprint) with the member against each other row of its group (id, fingerprint)."""
    one = group.where(F.col("id") == member).select(F.col("id").alias("x"), F.col("fingerprint").alias("fx"))
    others = group.where(F.col("id") != member).crossJoin(F.broadcast(one))  # one row
    first = F.col("id") < F.col("x")
    fresh = others.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"), F.when(first, F.col("fingerprint")).otherwise(F.col("fx")).alias("a_fingerprint"), F.when(first, F.col("fx")).otherwise(F.col("fingerprint")).alias("b_fingerprint"))
    return upsert(blocked, fresh, ["a", "b"])


def valid_blocks(blocked: DataFrame, features: DataFrame) -> DataFrame:
    """Blocked pairs whose rows still have the fingerprints of the edit."""
    now = features.select("id", "fingerprint")
    return (
        blocked.join(now.select(F.col("id").alias("a"), F.col("fingerprint").alias("a_fingerprint")), ["a", "a_fingerprint"], "left_semi")
        .join(now.select(F.col("id").alias("b"), F.col("fingerprint").alias("b_fingerprint")), ["b", "b_fingerprint"], "left_semi")
        .select(*blocked.columns)
    )


def valid_groups(groups: DataFrame, features: DataFrame, suppressed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Groups (group, signature, id) whose members all exist, that are not suppressed and hold no blocked pair."""
    gone = groups.join(features.select("id"), "id", "left_anti").select("group")
    pairs = blocked.join(groups.select("group", F.col("id").alias("a")), "a").join(groups.select("group", F.col("id").alias("b")), ["group", "b"]).select("group")
    out = groups.join(suppressed.select("signature"), "signature", "left_anti")
    return out.join(gone.unionByName(pairs).distinct(), "group", "left_anti").select(*groups.columns)
