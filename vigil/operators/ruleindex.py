"""Long first-match rule tables, found through what the rules fix.

Rules that fix the same fields, with addresses fixed to the same number of bits, form a class.  The values of these
fields are the key of a rule, and a packet has one key per class, so that the rules that may hold for a packet are
found by equality.  The work of a packet grows with the number of classes, not of rules.  Rules behind one that holds
for every packet are left out before, and packets that are the same to all rules are looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil import fixed
from vigil.functions.network import cidr_high, cidr_low, ip_to_num, prefix_length
from vigil.operators.skew import positions
from vigil.session import durable
from vigil.tables import bounded_broadcast

#: Networks stand in classes by their prefix length, rounded down to a multiple.
STEP = 4
SIDES = ("src_ip", "dst_ip")
#: Level of a network that is no network: it holds for the same text only.
TEXT = -1
FIXED = ["protocol", "direction", "src_port", "dst_port"]
EVERYWHERE = ("any", "0.0.0.0/0")
#: Ports and flags that no rule names are the same to all rules; found out up to this many named ones.
MAX_NAMED = 1_000


def reachable(rules: DataFrame) -> DataFrame:
    """Enabled rules up to the first that holds for every packet: those behind it never decide."""
    enabled = rules.where("enabled")
    open_parts = [F.col(n) == "ANY" for n in ("direction", "protocol")] + [F.col(n).isin(*EVERYWHERE) for n in SIDES]
    open_parts += [F.coalesce(n, F.lit(0)) == 0 for n in ("src_port", "dst_port")]
    open_parts += [F.coalesce(n, F.lit("")) == "" for n in ("zone_src", "zone_dst")]
    open_parts.append(F.coalesce(F.size("tcp_flags"), F.lit(0)) <= 0)
    last = enabled.where(_same(open_parts)).orderBy("priority", "seq").select("priority", "seq").first()
    if last is None:
        return enabled
    before = (F.col("priority") < last["priority"]) | (F.col("priority") == last["priority"]) & (F.col("seq") <= last["seq"])
    return enabled.where(F.coalesce(before, F.lit(True)))


def _masked(number: Column, level: Column) -> Column:
    """The first ``level`` bits of an address."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - level)
    return number - number % size


def _key(kind: Column, values: dict[str, Column], numbers: dict[str, Column], texts: dict[str, Column]) -> Column:
    """Hash of a class and the values of what it fixes."""
    parts = [F.when(kind[f"has_{n}"], values[n].cast("string")) for n in FIXED]
    for side in SIDES:
        level = kind[f"level_{side}"]
        masked = _masked(numbers[side], level).cast("string")
        parts.append(F.when(level == TEXT, texts[side]).when(level > 0, masked))
    return F.xxhash64(kind["class"], *[F.coalesce(p, F.lit("")) for p in parts])


def _levels(rules: DataFrame, side: str) -> Column:
    """Levels at which a network is looked up: 0 for all addresses; else that of its length, and its text."""
    text = F.col(side)
    length = (F.floor(prefix_length(side) / STEP) * STEP).cast("int")
    return (F.when(text.isin(*EVERYWHERE), F.array(F.lit(0)))
            .when(length.isNull(), F.array(F.lit(TEXT))).otherwise(F.array(length, F.lit(TEXT))))


def _numbered(rules: DataFrame) -> DataFrame:
    """Rules that may decide with their rank; of those that ask for exactly the same, the first alone."""
    asked = ["direction", "protocol", *SIDES, "src_port", "dst_port", "flags", "zone_src", "zone_dst"]
    ranges = {f"{n}_{end}": f(n) for n in SIDES for end, f in (("low", cidr_low), ("high", cidr_high))}
    ranked = positions(reachable(rules), ["priority", "seq"], "rank").withColumns({
        "flags": F.sort_array(F.array_distinct(F.coalesce("tcp_flags", F.array().cast("array<string>")))),
        **{n: F.coalesce(n, F.lit(0)) for n in ("src_port", "dst_port")}, **{n: F.coalesce(n, F.lit("")) for n in ("zone_src", "zone_dst")}})
    return ranked.groupBy(*asked).agg(F.min("rank").alias("rank"), F.min_by(F.struct("rule_id", "name", "action"), "rank").alias("rule")).withColumns(ranges)


def _holds() -> Column:
    """Whether the rule of a joined row holds for its packet, all its parts looked at."""
    rule, packet = (lambda n: F.col(f"r_{n}")), F.col
    tests = [(rule(n) == "ANY") | (rule(n) == packet(n)) for n in ("direction", "protocol")]
    for n in SIDES:
        inside = F.coalesce(packet(f"_{n}").between(rule(f"{n}_low"), rule(f"{n}_high")), F.lit(False))
        tests.append(rule(n).isin(*EVERYWHERE) | inside | (packet(n) == rule(n)))
    tests += [(rule(n) == 0) | (rule(n) == packet(n)) for n in ("src_port", "dst_port")]
    tests.append(F.size(F.array_except(rule("flags"), packet("tcp_flags"))) == 0)
    for n in ("zone_src", "zone_dst"):
        zone = F.coalesce(packet(n), F.lit(""))
        tests.append((rule(n) == "") | (zone == "") | (zone == rule(n)))
    held = tests[0]
    for test in tests[1:]:
        held = held & test
    return held


def _asked(rules: DataFrame) -> dict[str, Column]:
    """All of a packet that the rules look at, by column of the packet; packets equal in these meet the same rules."""
    def named(values):
        found = [r[0] for r in rules.select(values).distinct().limit(MAX_NAMED + 1).collect()]
        return found if len(found) <= MAX_NAMED and None not in found else None
    asked = {n: F.col(n) for n in ("direction", "protocol", *SIDES)}
    for n in ("src_port", "dst_port"):
        ports = named(n)
        asked[n] = F.col(n) if ports is None else F.when(F.col(n).isin(ports), F.col(n))
    flags, held = named(F.explode("tcp_flags")), F.coalesce("tcp_flags", F.array().cast("array<string>"))
    asked["tcp_flags"] = F.array_sort(F.array_distinct(held if flags is None else F.filter(held, lambda f: f.isin(flags))))
    for n in ("zone_src", "zone_dst"):
        asked[n] = F.lit("") if named(F.coalesce(n, F.lit(""))) in ([""], []) else F.coalesce(n, F.lit(""))
    return asked


def once_each(packets: DataFrame, rules: DataFrame, decide) -> DataFrame:
    """``decide`` over packets, which adds ``rule_id, rule_name, rule_action``; packets that are the same to all rules are decided once.

    Packets are written once, and what ``decide`` says of each kind of packet joins with them, by broadcast if the kinds
    are shown to be few and by shuffle otherwise.
    """
    spark, asked, packets = packets.sparkSession, _asked(rules), durable(packets)
    # few as kinds may be, each may meet many rules: they are dealt over all tasks again
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = durable(packets.select(*[c.alias(n) for n, c in asked.items()]).distinct().repartition(tasks)
                    .withColumn("_row", F.monotonically_increasing_id()))
    told = durable(decide(kinds).select(*[F.col(n).alias(f"_asked_{n}") for n in asked], "rule_id", "rule_name", "rule_action"))
    told = bounded_broadcast(told.hint("shuffle_hash"))
    return (packets.join(told, _same([c.eqNullSafe(F.col(f"_asked_{n}")) for n, c in asked.items()]), "left")
            .select(*packets.columns, "rule_id", "rule_name", "rule_action"))


def apply_index(packets: DataFrame, rules: DataFrame, default_policy: str = fixed.DEFAULT_POLICY) -> DataFrame:
    """Add ``rule_id, rule_name, rule_action`` of the first enabled rule that holds, as the CASE of a short table does.

    Only the classes that occur come to the driver; there are at most some hundreds whatever the number of rules.
    Packets have a number ``_row``; their keys join with those of the rules, by broadcast if the rules are shown to be few
    and by shuffle otherwise, and the least rank per packet is taken map-side first.
    Addresses that are none meet the rules that name the same text.
    """
    ranked = durable(_numbered(rules))
    kinds = ranked.select("*", F.explode(_levels(ranked, "src_ip")).alias("level_src_ip")).select(
        "*", F.explode(_levels(ranked, "dst_ip")).alias("level_dst_ip"))
    kinds = kinds.withColumns({f"has_{n}": F.col(n) != (0 if n.endswith("port") else "ANY") for n in FIXED})
    shape = [*[f"has_{n}" for n in FIXED], *[f"level_{n}" for n in SIDES]]
    classes = sorted(map(tuple, kinds.select(*shape).distinct().collect()))
    named = F.array(*[F.struct(F.lit(n).alias("class"), *[F.lit(v).alias(c) for c, v in zip(shape, row)]) for n, row in enumerate(classes)])
    if not classes:
        return _with_rule(packets.withColumn("_best", F.lit(None).cast("bigint")), ranked, default_policy)

    # every rule finds the number of its class, and hence its key, as the packets do
    own = F.filter(named, lambda k: _same([k[c] == F.col(c) for c in shape]))[0]
    values = {n: F.col(n) for n in FIXED}
    index = kinds.withColumn("_kind", own).select(
        _key(F.col("_kind"), values, {n: F.col(f"{n}_low") for n in SIDES}, {n: F.col(n) for n in SIDES}).alias("_key"), "rank",
        *[F.col(c).alias(f"r_{c}") for c in ("direction", "protocol", *SIDES, "src_port", "dst_port", "flags", "zone_src", "zone_dst",
                                             *[f"{n}_{end}" for n in SIDES for end in ("low", "high")])])
    index = bounded_broadcast(durable(index))

    looked_at = packets.select("*", *[ip_to_num(n).alias(f"_{n}") for n in SIDES])
    numbers = {n: F.col(f"_{n}") for n in SIDES}
    fits = lambda k: _same([(k[f"level_{n}"] == 0) | ((k[f"level_{n}"] == TEXT) == numbers[n].isNull()) for n in SIDES])
    keys = F.transform(F.filter(named, fits), lambda k: _key(k, values, numbers, {n: F.col(n) for n in SIDES}))
    probes = looked_at.withColumn("_key", F.explode(F.array_distinct(keys)))
    best = probes.join(index, "_key").where(_holds()).groupBy("_row").agg(F.min("rank").alias("_best"))
    return _with_rule(packets.join(best, "_row", "left"), ranked, default_policy)


def _same(tests) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _with_rule(packets: DataFrame, ranked: DataFrame, default_policy: str) -> DataFrame:
    named = bounded_broadcast(ranked.select(F.col("rank").alias("_rank"), "rule"))
    return (packets.join(named, F.col("_best") == F.col("_rank"), "left")
            .withColumns({"rule_id": F.coalesce("rule.rule_id", F.lit(-1)), "rule_name": F.coalesce("rule.name", F.lit("")),
                          "rule_action": F.coalesce("rule.action", F.lit(default_policy))})
            .drop("_row", "_best", "_rank", "rule"))
