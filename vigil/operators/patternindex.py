"""Long tables of texts and patterns, found through letters that a match must contain.

Every pattern has stretches of plain letters without which it cannot match.  Three letters of such a stretch, the ones
that fewest patterns share, stand for it; a payload meets the patterns whose letters it contains by equality, and
only these are tried on it.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigil.operators.skew import positions
from vigil.session import durable
from vigil.tables import bounded_broadcast

GRAM = 3
_SINGLE = set("dDsSwWbBAZzGtnrfaehHvVR")          # escapes of one letter that stand for no letter of their own


def required_letters(pattern: str) -> list[str] | None:
    """Per alternative at the top of a pattern its longest stretch of plain ASCII letters; None if one has none.

    What stands in groups and classes is left out, and so is a letter that may be missing, so that a payload without
    these stretches cannot match.  Patterns with constructs that change how letters read are left without.
    """
    if "\\Q" in pattern or re.search(r"\(\?[A-Za-z-]*[xuU]", pattern):
        return None
    best, run, out, at, depth = "", "", [], 0, 0

    def stop():
        nonlocal best, run
        best, run = max(best, run, key=len), ""
    while at < len(pattern):
        c = pattern[at]
        if c == "[":                                 # a class, as far as its closing bracket
            stop()
            level, at = 1, at + 1 + pattern.startswith("[^", at)
            at += pattern.startswith("]", at)
            while at < len(pattern) and level:
                level += {"[": 1, "]": -1}.get(pattern[at], 0)
                at += 2 if pattern[at] == "\\" else 1
            continue
        if c == "\\":
            escaped = pattern[at + 1:at + 2]
            if escaped.isalnum():
                if escaped not in _SINGLE:
                    return None
                stop()
            elif depth == 0:
                run += escaped if escaped.isascii() else ""
                if not escaped.isascii():
                    stop()
            at += 2
            continue
        if c in "()":
            stop()
            depth += 1 if c == "(" else -1
        elif depth == 0 and c == "|":
            stop()
            out.append(best)
            best = ""
        elif depth == 0 and c in "*?{":
            run = run[:-1]
            stop()
            if c == "{":
                at = max(pattern.find("}", at), at)
        elif depth == 0 and c not in "+.^$" and c.isascii():
            run += c
        else:
            stop()
        at += 1
    stop()
    out.append(best)
    return [f.lower() for f in out] if all(out) else None


def _grams_of(letters: str) -> list[str]:
    size = min(GRAM, len(letters))
    return sorted({letters[k:k + size] for k in range(len(letters) - size + 1)})


def _anchors(patterns: DataFrame, text: str, plain: bool) -> DataFrame:
    """(rank, gram): for every alternative of a pattern the letters that fewest alternatives share; gram is null
    for patterns that require none."""
    def grams(batches):
        for batch in batches:
            found = [[p] if p else None for p in batch.column(1).to_pylist()] if plain else \
                [required_letters(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f and [_grams_of(x) for x in f] for f in found],
                                                                        pa.list_(pa.list_(pa.string())))], names=["rank", "parts"])
    parts = durable(patterns.select("rank", F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(grams, "rank bigint, parts array<array<string>>"))
    each = parts.select("rank", F.posexplode("parts").alias("part", "grams")).select("rank", "part", F.explode("grams").alias("gram"))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(shared, "gram").groupBy("rank", "part").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return durable(rarest.select("rank", "gram").distinct().unionByName(parts.where("parts IS NULL").select("rank", F.lit(None).cast("string").alias("gram"))))


def _payload_grams(text: Column, sizes: list[int]) -> Column:
    """All different stretches of these sizes in a text."""
    def stretches(c, size):
        return F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda k: F.concat(*[F.get(c, k + n) for n in range(size)]))

    def cut(c):
        return F.array_distinct(F.concat(*[F.when(F.size(c) >= size, stretches(c, size)).otherwise(F.array().cast("array<string>")) for size in sizes]))
    return F.transform(F.array(F.filter(F.split(text, ""), lambda x: x != "")), cut)[0]


def first_hits(packets: DataFrame, patterns: DataFrame, text: str, order: list[str], fold: bool, holds, literal) -> tuple[DataFrame, DataFrame]:
    """(packets with ``_best``, ranked patterns): the rank of the first pattern in ``order`` that holds, null without one.

    ``holds()`` tests a row with the packet's columns and the pattern's, prefixed ``r_``; ``literal(row)`` is the same for one
    pattern as an expression, which is used for patterns that require no letters: those are tried on all packets
    whatever the plan.  Of patterns that ask for the same the first alone is tried, and packets that a pattern cannot tell
    apart are one row until the end, so that neither copies of patterns nor of payloads multiply.
    """
    ranked = positions(patterns, order, "rank")
    asked = [c for c in ("protocol", "dst_port", text) if c in ranked.columns]
    rest = [c for c in ranked.columns if c not in asked]
    ranked = durable(ranked.groupBy(*asked).agg(F.min_by(F.struct(*rest), "rank").alias("_first")).select(
        *[F.col(c if c in asked else f"_first.{c}").alias(c) for c in ranked.columns]))
    anchors = _anchors(ranked, text, plain=not fold)
    known = [c for c in ("protocol", "dst_port") if c in packets.columns]
    kinds = durable(packets.select(*known, "payload").distinct().withColumn("_row", F.monotonically_increasing_id()))
    payload = F.coalesce(F.col("payload"), F.lit(""))
    sizes = sorted(r[0] for r in anchors.where("gram IS NOT NULL").select(F.length("gram")).distinct().collect())
    described = ranked.select("rank", *[F.col(c).alias(f"r_{c}") for c in ranked.columns if c != "rank"])
    best = packets.sparkSession.createDataFrame([], "_row bigint, _best bigint")
    if sizes:
        # what few bytes say about a packet goes with its letters, its payload only with the patterns that it meets
        index = bounded_broadcast(durable(anchors.where("gram IS NOT NULL").join(described.drop(f"r_{text}"), "rank")))
        met = kinds.select("_row", *known, F.explode(_payload_grams(F.lower(payload) if fold else payload, sizes)).alias("gram")).join(index, "gram")
        met = met.where(holds(payload=False)).select("_row", "rank").distinct()
        tried = met.join(described.select("rank", f"r_{text}"), "rank").join(kinds.select("_row", payload.alias("payload")), "_row")
        best = tried.where(holds(payload=True)).groupBy("_row").agg(F.min("rank").alias("_best"))
    rest = ranked.join(anchors.where("gram IS NULL").select("rank"), "rank", "left_semi").orderBy("rank").collect()
    judged = kinds.join(best, "_row", "left")
    if rest:
        from vigil.operators.rules import first_of
        everywhere = first_of([literal(row) for row in rest], [F.lit(row["rank"]).cast("bigint") for row in rest])
        judged = judged.withColumn("_best", F.least("_best", everywhere))
    judged = durable(judged.select(*[F.col(c).alias(f"_k_{c}") for c in (*known, "payload")], "_best"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*known, "payload")])
    found = packets.join(bounded_broadcast(judged), same, "left").select(*packets.columns, "_best")
    return found, ranked
