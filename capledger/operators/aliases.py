"""Names behind aliases of aliases, and the attributes that a name has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Rounds after which something must be wrong: each doubles the hops that all pointers have made.
MOST_ROUNDS = 64


def resolve_aliases(aliases: DataFrame, alias: str = "alias", target: str = "target") -> DataFrame:
    """alias, name, hops, status and cycle for each alias: the name at the end of its chain, by pointer jumping.

    Each round joins the pointers that have not ended with themselves, so a chain of n is done in log2(n) rounds; a round
    is a join on the alias and a table.  Aliases that no chain's end comes of lead into a cycle: status cycle, name
    and hops null, cycle the least alias of that cycle.  Others have status resolved and cycle null.

    Of an alias with several targets the least counts.  An alias of itself is a name: hops 0.  Rows with a null alias
    or target are left out; repeated rows count once; an empty table gives an empty result.
    """
    one = aliases.where(F.col(alias).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(alias).alias("alias")).agg(F.min(target).alias("name"))
    own = F.col("alias") == F.col("name")
    now = stored(one.select("alias", "name", F.when(own, 0).otherwise(1).cast("long").alias("hops"), F.least("alias", "name").alias("least"), own.alias("ended")))
    done, moving, jumped, n = now.where("ended"), now.where("not ended"), 1, None
    for _ in range(MOST_ROUNDS):
        before, n = n, moving.count()
        if not n or (n == before and jumped > n):
            break
        # A pointer has ended when no alias is where it leads; else it takes over where that one leads, and whether it has ended.
        on = done.unionByName(moving).select(F.col("alias").alias("name"), F.struct("name", "hops", "least", "ended").alias("on"))
        jump = F.col("on").isNotNull()
        met = moving.join(on, "name", "left").select("alias", F.when(jump, F.col("on.name")).otherwise(F.col("name")).alias("name"), (F.col("hops") + F.coalesce("on.hops", F.lit(0))).alias("hops"), F.least("least", "on.least").alias("least"), F.coalesce("on.ended", F.lit(True)).alias("ended"))
        met = stored(met)
        done, moving, jumped = done.unionByName(met.where("ended")), met.where("not ended"), jumped * 2
    else:
        raise RuntimeError("the aliases did not settle")
    # What still moves has made more hops than there are such aliases, so it is in its cycle; the least alias that its
    # place passes, in a full turn and more, names the cycle.
    cyclic = moving.select("alias", "name").join(moving.select(F.col("alias").alias("name"), F.col("least").alias("cycle")), "name")
    nothing = F.lit(None)
    ends = done.select("alias", "name", "hops", F.lit("resolved").alias("status"), nothing.cast("string").alias("cycle"))
    return ends.unionByName(cyclic.select("alias", nothing.cast("string").alias("name"), nothing.cast("long").alias("hops"), F.lit("cycle").alias("status"), F.col("cycle").cast("string")))


def look_up(df: DataFrame, name: str, resolved: DataFrame, attributes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with canonical (the name that its name is an alias of, or itself) and the columns that attributes has of that.

    Of several rows of attributes with one key the least counts, column by column together; a name without
    attributes, and a name whose alias leads into a cycle, has nulls.  Both look-ups are plain left joins: small tables are
    broadcast by their size, large ones meet by key.
    """
    known = resolved.select(F.col("alias").alias(name), F.col("name").alias("_end"), (F.col("status") == "cycle").alias("_lost"))
    out = df.join(known, name, "left").withColumn("canonical", F.when(F.coalesce("_lost", F.lit(False)), None).otherwise(F.coalesce("_end", name))).drop("_end", "_lost")
    one = attributes.groupBy(F.col(key).alias("canonical")).agg(F.min(F.struct(*columns)).alias("_a"))
    return out.join(one, "canonical", "left").select(*df.columns, "canonical", *[F.col("_a")[c].alias(c) for c in columns])
