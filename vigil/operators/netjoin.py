"""Joins of addresses to networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil.functions.network import cidr_high, cidr_low, ip_to_num, literal_range, prefix_length
from vigil.session import durable
from vigil.tables import BROADCAST_ROWS

# Up to this many networks become a CASE expression instead of a join.
COMPILED_NETWORKS = 64


def _case(number: Column, rows, columns, rank, cidr, types) -> dict[str, Column]:
    """One CASE per result column over constant ranges, best rank first, longer prefix next."""
    def order(row):
        low, high = literal_range(row[cidr])
        return (-row[rank], high - low)

    out = {}
    for name in columns:
        column = F.lit(None)
        for row in sorted(rows, key=order, reverse=True):
            low, high = literal_range(row[cidr])
            column = F.when(number.between(low, high), F.lit(row[name])).otherwise(column)
        out[name] = column.cast(types[name])
    return out


def match_networks(df: DataFrame, ip: str, networks: DataFrame, columns: list[str], rank: str,
                   cidr: str = "cidr") -> DataFrame:
    """Left join to the matching network with the largest ``rank``; ties take the longer prefix.

    A range condition would compare every row with every network.  A short list becomes a CASE
    over constant ranges.  A longer one becomes an equi-join on the masked address for each of
    the eight block lengths /4, /8 .. /32 that occur, so the work per row does not grow with the
    number of networks.  ``columns`` of the match are NULL without one.
    """
    valid = networks.where(prefix_length(cidr).isNotNull())
    types = {c: networks.schema[c].dataType for c in columns}
    few = valid.limit(COMPILED_NETWORKS + 1).collect()
    if len(few) <= COMPILED_NETWORKS:
        number = F.col("_number")
        return (df.withColumn("_number", ip_to_num(ip))
                .withColumns(_case(number, few, columns, rank, cidr, types)).drop("_number"))
    # a network is cut into the blocks of the next length in steps of four (at most 16 of them)
    level = F.greatest(F.lit(4), F.ceil(F.col("_length") / 4) * 4).cast("int")
    block = F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - F.col("_level"))
    blocks = (valid.withColumns({"_length": prefix_length(cidr), "_low": cidr_low(cidr), "_high": cidr_high(cidr)})
              .withColumn("_level", level)
              .withColumn("_key", F.explode(F.sequence("_low", "_high", block)))
              .groupBy("_level", "_key")
              .agg(F.max(F.struct(F.col(rank).alias("rank"), F.col("_length").alias("length"),
                                  F.struct(*columns).alias("match"))).alias("_match")))
    # worked out once and not once per length; only one count per length comes to the driver
    blocks = durable(blocks)
    sizes = {r[0]: r[1] for r in blocks.groupBy("_level").count().collect()}
    out = df.withColumn("_number", ip_to_num(ip))
    for n, rows in sorted(sizes.items()):
        side = blocks.where(F.col("_level") == n).select("_key", F.col("_match").alias(f"_m{n}"))
        masked = F.col("_number") - F.col("_number") % F.lit(2 ** (32 - n)).cast("bigint")
        side = F.broadcast(side) if rows <= BROADCAST_ROWS else side
        out = out.join(side, masked == F.col("_key"), "left").drop("_key")
    # greatest() skips NULLs and compares rank first, then length
    found = [F.col(f"_m{n}") for n in sizes]
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return (out.withColumn("_best", best).drop("_number", *[f"_m{n}" for n in sizes])
            .withColumns({c: F.col(f"_best.match.{c}") for c in columns}).drop("_best"))


def in_networks(df: DataFrame, ip: str, networks: DataFrame, flag: str, cidr: str = "cidr") -> DataFrame:
    """Add a boolean: the address lies in one of the networks."""
    listed = networks.select(F.col(cidr), F.lit(True).alias(flag), F.lit(1).alias("_one"))
    out = match_networks(df, ip, listed, [flag], "_one", cidr)
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
