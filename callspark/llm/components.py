"""Connected groups from shared keys, with every link confirmed, and no group ever expanded into all pairs.

``link_groups`` takes (key, id) memberships and a function that confirms pairs. It first ties each member
of a key to one leader, the member that meets most others over all its keys (pairs grow with the members, not
with their square), and merges what is confirmed.
Members of a key that already are in one component need no further pairs. What remains - members outside the
most frequent component of their key - is then compared with all members of the key in other components, but
for pairs that an exact bound rules out, so no link between two components is lost. Each such pair is made once, however
many keys both have; their number can still grow with the square of the members of a key that are not linked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callspark.llm.staging import Stage


def connected_components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id of ``edges`` (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that label; labels
    are written after each round, so a lost executor costs one round at most.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = stage.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(stage.side(labels), both.b == labels.id).select(F.col("a").alias("id"), "component", F.lit(None).cast("long").alias("old"))
        own = labels.select("id", "component", F.col("component").alias("old"))
        near = heard.unionByName(own).groupBy("id").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("further"))
        new = near.join(stage.side(labels, jump), near.component == jump["at"]).select("id", "old", F.least("component", "further").alias("component"))
        new = stage.write(new, "labels", moved=F.count_if(F.col("component") < F.col("old")))
        stage.drop(labels)
        labels = new
        if not stage.counted(new)["moved"]:
            return labels


def link_groups(stage: Stage, members: DataFrame, confirm: Callable[[DataFrame], DataFrame], bound: Callable[[DataFrame], tuple[DataFrame, str]]) -> DataFrame | None:
    """Components of the ids of ``members`` (key long, id long, without repeats) under confirmed links.

    ``confirm`` gets pairs (a < b, each once, a table of ``stage``) and returns those that are linked. ``bound``
    gets the (lead, id, component) still to compare, where ``lead`` is the leader of a key of the id, and returns a table
    (lead, id, facts) and a condition on the facts of two ids under one lead, named with _x and _y, that holds for each
    pair that can be linked across components; ids without facts have no such link. Returns (id, component, ...) for ids with at least one link, or None if there is none.
    """
    low_high = (F.least("id", "one").alias("a"), F.greatest("id", "one").alias("b"))
    shared = stage.write(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    if not stage.rows(shared):
        return None
    held = stage.write(members.join(stage.side(shared), "key"), "members")
    stage.drop(shared)
    # the least changed copy of a group meets most others
    central = stage.write(held.groupBy("id").agg(F.sum("n").alias("met")), "central")
    lead = held.join(stage.side(central), "id").groupBy("key").agg(F.max(F.struct("met", "id"))["id"].alias("one"))
    lead = stage.write(lead, "leaders")
    pairs = stage.write(held.join(stage.side(lead), "key").where("id <> one").select(*low_high).distinct(), "pairs")
    edges = stage.write(confirm(pairs), "links")
    stage.drop(central, pairs)
    parts = connected_components(stage, edges) if stage.rows(edges) else None

    members_of = held.select("key", "id")
    if parts is None:
        of = members_of.withColumn("component", F.col("id"))
    else:
        of = members_of.join(stage.side(parts, parts.select("id", "component")), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    each = of.groupBy("key", "component").agg(F.count("*").alias("n"))
    opened = each.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("most"), F.count("*").alias("parts")).where("parts > 1")
    opened = stage.write(opened.select("key", "most"), "open")
    if not stage.rows(opened):
        return parts
    left = of.join(stage.side(opened), "key").join(stage.side(lead, lead.withColumnRenamed("one", "lead")), "key")
    left = stage.write(left, "unsettled")
    stage.drop(held, lead, opened)
    facts, possible = bound(stage.write(left.select("lead", "id", "component").distinct(), "ids"))
    facts = stage.write(facts, "facts")
    names = [c for c in facts.columns if c not in ("lead", "id")]
    known = stage.write(left.join(stage.side(facts), ["lead", "id"]), "known")
    # a pair is made under the smallest key that both have, and so once
    keys_of = stage.write(known.groupBy("id").agg(F.collect_list("key").alias("keys")), "keys-of")
    known = stage.write(known.join(stage.side(keys_of), "id"), "known")
    names.append("keys")
    one = known.where("component <> most").select("key", F.col("id").alias("one"), F.col("component").alias("its"), *(F.col(c).alias(f"{c}_x") for c in names))
    two = known.select("key", "id", "component", "most", *(F.col(c).alias(f"{c}_y") for c in names))
    once = "(component = most or id < one) and array_min(array_intersect(keys_x, keys_y)) = key"
    pairs = two.join(stage.side(known, one), "key").where(f"component <> its and ({possible}) and {once}").select(*low_high)
    pairs = stage.write(pairs, "pairs")
    if stage.rows(pairs):
        more = stage.write(confirm(pairs), "links")
        if stage.rows(more):
            parts = connected_components(stage, edges.union(more))
    return parts
