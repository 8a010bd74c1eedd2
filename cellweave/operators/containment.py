"""Which of many sets contain others: a join by containment on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extremal_sets(sets: DataFrame, keep: str = "minimal") -> DataFrame:
    """(group_id, members): of the sets (group_id, members, an array) those that contain no other set of their group, or
    with keep="maximal" lie in none; each once, members in order.

    A set lies in another one only if its rarest member does, so each set is filed under that member alone and met by the
    sets that have it; sets that share only frequent members never meet. Nulls among members don't count, a null array is
    no set, the empty set lies in all others, and a null group is a group.
    """
    own = sets.where("members IS NOT NULL").select("group_id", F.array_sort(F.array_distinct(F.array_compact("members"))).alias("members")).distinct()
    each = own.select("group_id", "members", F.explode("members").alias("e"))
    n = each.groupBy("group_id", "e").agg(F.count(F.lit(1)).alias("n"))
    counted = each.alias("x").join(n.alias("n"), F.expr("x.group_id <=> n.group_id AND x.e = n.e")).select("x.group_id", "x.members", "x.e", "n.n")
    filed = counted.groupBy("group_id", "members").agg(F.min(F.struct("n", "e"))["e"].alias("e"))
    meets = F.expr("b.group_id <=> s.group_id AND b.e = s.e") & (F.size("s.members") < F.size("b.members")) & (F.size(F.array_except("s.members", "b.members")) == 0)
    less = "b" if keep == "minimal" else "s"
    beaten = each.alias("b").join(filed.alias("s"), meets).select(f"{less}.group_id", f"{less}.members")
    # the empty set has no member to be filed under
    groups = own.groupBy("group_id").agg(F.bool_or(F.size("members") == 0).alias("empty"), F.bool_or(F.size("members") > 0).alias("other"))
    whole = own.alias("o").join(groups.alias("g"), F.expr("o.group_id <=> g.group_id")).select("o.group_id", "o.members", "empty", "other")
    left = whole.where(~F.col("empty") | (F.size("members") == 0)) if keep == "minimal" else whole.where(~F.col("other") | (F.size("members") > 0))
    return left.alias("l").join(beaten.distinct().alias("d"), F.expr("l.group_id <=> d.group_id AND l.members = d.members"), "left_anti").select("group_id", "members")
