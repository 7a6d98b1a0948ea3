"""IPv4 expressions: everything takes and returns Columns and stays in generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigil import fixed

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
CIDR = rf"^{_OCTET}(\.{_OCTET}){{3}}/(3[0-2]|[12]?\d)$"
INTERNAL = r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_valid_ip(ip) -> Column:
    return F.coalesce(_c(ip).rlike(IPV4), F.lit(False))


def is_valid_cidr(cidr) -> Column:
    """Address with prefix length; bits below the prefix may be set.  A bare address counts."""
    return F.coalesce(_c(cidr).rlike(CIDR) | _c(cidr).rlike(IPV4), F.lit(False))


def ip_to_num(ip) -> Column:
    """Number of a dotted address, NULL when the text is not one."""
    # as a function over the four parts the expression stays small: several of them and the tests that use them
    # would otherwise become one generated method too long for the JVM to compile
    number = F.aggregate(F.split(_c(ip), r"\."), F.lit(0).cast("bigint"), lambda n, octet: n * 256 + octet.try_cast("bigint"))
    return F.when(is_valid_ip(ip), number)


def num_to_ip(number) -> Column:
    n = _c(number)
    return F.concat_ws(".", *[F.shiftright(n, 8 * k).bitwiseAND(F.lit(255)).cast("string")
                              for k in (3, 2, 1, 0)])


def prefix_length(cidr) -> Column:
    """Prefix length of a CIDR text; 32 for a bare address."""
    text = _c(cidr)
    return F.when(is_valid_cidr(text),
                  F.coalesce(F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int"), F.lit(32)))


def block_size(prefix) -> Column:
    return F.expr("CAST(1 AS BIGINT)") if prefix is None else \
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - _c(prefix))


def cidr_low(cidr) -> Column:
    size = block_size(prefix_length(cidr))
    address = ip_to_num(F.split_part(_c(cidr), F.lit("/"), F.lit(1)))
    return address - address % size


def cidr_high(cidr) -> Column:
    return cidr_low(cidr) + block_size(prefix_length(cidr)) - F.lit(1)


def literal_range(cidr: str) -> tuple[int, int]:
    """(low, high) of a constant CIDR text, worked out when the plan is built."""
    address, _, prefix = cidr.partition("/")
    number = 0
    for part in address.split("."):
        number = number * 256 + int(part)
    size = 2 ** (32 - int(prefix or 32))
    return number - number % size, number - number % size + size - 1


def in_network(ip, cidr: str, number: Column | None = None) -> Column:
    """Constant-network test.  ``any`` and ``0.0.0.0/0`` hold for all text, bad text compares equal.

    ``number`` is the numeric address when it is at hand.
    """
    if cidr in ("any", "0.0.0.0/0"):
        return F.lit(True)
    if not (re.search(CIDR, cidr) or re.search(IPV4, cidr)):
        return _c(ip) == F.lit(cidr)
    low, high = literal_range(cidr)
    number = ip_to_num(ip) if number is None else number
    return F.coalesce(number.between(low, high), _c(ip) == F.lit(cidr))


def ip_in_cidr(ip, cidr) -> Column:
    """Test of two columns, with the same rules as :func:`in_network`."""
    text = _c(cidr)
    inside = ip_to_num(ip).between(cidr_low(text), cidr_high(text))
    return (F.when(text.isin("any", "0.0.0.0/0"), F.lit(True))
            .when(is_valid_ip(ip) & is_valid_cidr(text), inside)
            .otherwise(_c(ip) == text))


def is_internal(ip) -> Column:
    return F.coalesce(_c(ip).rlike(INTERNAL), F.lit(False))


def is_private(low, high) -> Column:
    """Whole block [low, high] inside one of the reserved ranges."""
    tests = []
    for cidr in fixed.PRIVATE_NETWORKS:
        first, last = literal_range(cidr)
        tests.append((_c(low) >= F.lit(first)) & (_c(high) <= F.lit(last)))
    return reduce(lambda a, b: a | b, tests)


def network_class(low) -> Column:
    first = F.shiftright(_c(low), 24)
    return (F.when(first < 128, "A").when(first < 192, "B").when(first < 224, "C")
            .when(first < 240, "D").otherwise("E"))


def subnet_columns(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Network facts of a CIDR column: addresses, masks, host counts, class, private flag."""
    total = F.col("total_hosts")
    return (df.withColumns({"_low": cidr_low(cidr), "prefix_length": prefix_length(cidr)})
            .withColumn("total_hosts", block_size("prefix_length"))
            .withColumn("_high", F.col("_low") + total - 1)
            .withColumns({
                "network_address": num_to_ip("_low"),
                "broadcast_address": num_to_ip("_high"),
                "subnet_mask": num_to_ip(F.lit(4294967296).cast("bigint") - total),
                "wildcard_mask": num_to_ip(total - 1),
                "usable_hosts": F.greatest(F.lit(0).cast("bigint"), total - 2),
                "first_host": num_to_ip(F.when(total > 2, F.col("_low") + 1).otherwise(F.col("_low"))),
                "last_host": num_to_ip(F.when(total > 2, F.col("_high") - 1).otherwise(F.col("_high"))),
                "is_private": is_private("_low", "_high"),
                "network_class": network_class("_low"),
            }).drop("_low", "_high"))


def expand_targets(df: DataFrame, spec: str = "target") -> DataFrame:
    """One row per address of a target text: address, CIDR, ``a.b.c.x-y`` or a comma list.

    A comma list is a set.  Networks shorter than /31 leave out network and broadcast address.
    """
    text = F.col(spec)
    parts = F.when(text.contains(",") & ~text.contains("/"),
                   F.array_distinct(F.transform(F.split(text, ","), lambda x: F.trim(x)))).otherwise(F.array(text))
    piece = F.col("_piece")
    total = block_size(prefix_length(piece))
    low = cidr_low(piece)
    range_pattern = r"^(\d+\.\d+\.\d+\.)(\d+)-(\d+)$"
    base = ip_to_num(F.concat(F.regexp_extract(piece, range_pattern, 1), F.lit("0")))
    start = F.regexp_extract(piece, range_pattern, 2).try_cast("bigint")
    stop = F.least(F.regexp_extract(piece, range_pattern, 3).try_cast("bigint"), F.lit(255).cast("bigint"))
    inset = F.when(total > 2, F.lit(1)).otherwise(F.lit(0))
    bounds = (F.when(piece.contains("/"),
                     F.when(is_valid_cidr(piece), F.struct((low + inset).alias("a"),
                                                           (low + total - 1 - inset).alias("b"))))
              .when(piece.rlike(range_pattern),
                    F.when(base.isNotNull() & (start <= stop),
                           F.struct((base + start).alias("a"), (base + stop).alias("b"))))
              .when(is_valid_ip(piece), F.struct(ip_to_num(piece).alias("a"), ip_to_num(piece).alias("b"))))
    # large networks go by way of their /16 blocks, so no array is longer than 65,536
    block = F.lit(65536).cast("bigint")
    first, last = F.col("_bounds.a"), F.col("_bounds.b")
    rows = (df.withColumn("_piece", F.explode(parts)).withColumn("_bounds", bounds)
            .where(F.col("_bounds").isNotNull())
            .withColumn("_block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block))))
            .withColumn("_n", F.explode(F.sequence(F.greatest(first, F.col("_block") * block),
                                                   F.least(last, (F.col("_block") + 1) * block - 1))))
            .withColumn("ip", num_to_ip("_n")).drop("_piece", "_bounds", "_block", "_n"))
    return rows.dropDuplicates()
