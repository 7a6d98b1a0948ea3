"""First-match rules: a short table becomes one CASE expression, a long one an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from vigil import fixed, tables
from vigil.functions.network import in_network, ip_to_num
from vigil.operators.patternindex import first_hits
from vigil.operators.ruleindex import apply_index, once_each, reachable

COMPILED_RULES = 500
#: With more rules than this, packets that are the same to all of them are decided once.
DIRECT_RULES = 50
MAX_PATTERNS = 500


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def rule_condition(rule: dict, numbers: dict[str, Column] | None = None) -> Column:
    """Condition of one firewall rule over a packet row; parts left open hold for all packets.

    Packets need direction, protocol, addresses, ports, ``tcp_flags`` and the two zone columns.
    ``numbers`` may name columns that already hold the numeric addresses.
    """
    tests = []
    for name in ("direction", "protocol"):
        if rule[name] != "ANY":
            tests.append(F.col(name) == rule[name])
    for name in ("src_ip", "dst_ip"):
        if rule[name] != "any":
            tests.append(in_network(name, rule[name], (numbers or {}).get(name)))
    for name in ("src_port", "dst_port"):
        if rule[name]:
            tests.append(F.col(name) == rule[name])
    if rule["tcp_flags"]:
        wanted = F.array(*[F.lit(f) for f in rule["tcp_flags"]])
        tests.append(F.size(F.array_except(wanted, F.col("tcp_flags"))) == 0)
    for name in ("zone_src", "zone_dst"):
        if rule[name]:
            zone = F.coalesce(F.col(name), F.lit(""))
            tests.append((zone == "") | (zone == rule[name]))
    return _all(tests)


def apply_rules(packets: DataFrame, rules: DataFrame | None = None,
                default_policy: str = fixed.DEFAULT_POLICY) -> DataFrame:
    """Add ``rule_id, rule_name, rule_action`` of the first enabled rule that matches.

    Lowest priority first, table order (``seq``) among equals.  Without a match the rule id is -1
    and the action is the default policy.  Packets without zone columns match every zone.
    Rules behind one that holds for every packet never decide and do not count.  Tables above ``COMPILED_RULES`` go through :func:`vigil.operators.ruleindex.apply_index`.
    """
    rules = tables.firewall_rules(packets.sparkSession) if rules is None else rules
    for name in ("zone_src", "zone_dst"):
        if name not in packets.columns:
            packets = packets.withColumn(name, F.lit(""))
    if "tcp_flags" not in packets.columns:
        packets = packets.withColumn("tcp_flags", F.array().cast("array<string>"))
    rules = reachable(rules)
    few = rules.orderBy("priority", "seq").limit(COMPILED_RULES + 1).collect()
    if len(few) > COMPILED_RULES:
        return once_each(packets, rules, lambda kinds: apply_index(kinds, rules, default_policy))
    if len(few) > DIRECT_RULES:
        return once_each(packets, rules, lambda kinds: _apply_case(kinds, few, default_policy))
    return _apply_case(packets, few, default_policy)


def _apply_case(packets: DataFrame, few: list, default_policy: str) -> DataFrame:
    # the CASE gives the place of the rule; its columns are then plain look-ups
    numbers = {n: F.col(f"_{n}") for n in ("src_ip", "dst_ip")}
    # one flat CASE: branches nested in each other take minutes to analyse when they are some hundreds
    place = F.coalesce(first_of([rule_condition(r.asDict(), numbers) for r in few], range(1, len(few) + 1)).cast("int"), F.lit(len(few) + 1))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_place"))
    return (packets.withColumns({f"_{n}": ip_to_num(n) for n in numbers}).withColumn("_place", place)
            .withColumns({"rule_id": pick([r["rule_id"] for r in few] + [-1]),
                          "rule_name": pick([r["name"] for r in few] + [""]),
                          "rule_action": pick([r["action"] for r in few] + [default_policy])})
            .drop("_place", "_src_ip", "_dst_ip"))


def rule_hits(decided: DataFrame) -> DataFrame:
    """Packets per rule that decided something."""
    return (decided.where(F.col("rule_id") > 0).groupBy("rule_id", "rule_name", "rule_action")
            .agg(F.count(F.lit(1)).alias("hits")))


def top_rules(decided: DataFrame, n: int = 10) -> DataFrame:
    return rule_hits(decided).orderBy(F.desc("hits"), "rule_id").limit(n)


def rule_set_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("total_rules"), F.count_if("enabled").alias("enabled_rules"),
                     F.count_if(~F.col("enabled")).alias("disabled_rules"))


def _signature_condition(s) -> Column:
    tests = [F.coalesce(F.col("payload"), F.lit("")).rlike("(?i)" + s["pattern"])]
    if s["protocol"] != "ANY":
        tests.insert(0, F.col("protocol") == s["protocol"])
    if s["dst_port"]:
        tests.insert(1, F.col("dst_port").isin(list(s["dst_port"])))
    return _all(tests)


def first_of(tests: list[Column], values: list) -> Column:
    """The value of the first test that holds, NULL without one."""
    place = None
    for test, value in zip(tests, values):
        place = F.when(test, value) if place is None else place.when(test, value)
    return F.lit(None) if place is None else place


def _picked(packets: DataFrame, ranked: DataFrame, columns: list[Column]) -> DataFrame:
    """Packets with ``columns`` of the pattern of rank ``_best``; a column may use the packet's too."""
    named = tables.bounded_broadcast(ranked.select(F.col("rank").alias("_rank"), F.struct(*[c for c in ranked.columns if c != "rank"]).alias("_hit")))
    return packets.join(named, F.col("_best") == F.col("_rank"), "left").select(*[c for c in packets.columns if c != "_best"], *columns)


def match_signatures(packets: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Add ``signature``: struct of the first matching payload signature, NULL without one.

    A short table is one expression with the cheap protocol and port tests first and patterns as literals; above
    ``MAX_PATTERNS`` an index of required letters finds the patterns to try (:mod:`vigil.operators.patternindex`).
    """
    signatures = tables.signatures(packets.sparkSession) if signatures is None else signatures
    names = ("sid", "name", "severity", "action", "category", "mitre")
    details = F.concat(F.lit("Matched: "), F.substring("payload", 1, 80)).alias("details")
    listed = signatures.orderBy("seq").limit(MAX_PATTERNS + 1).collect()
    if len(listed) > MAX_PATTERNS:
        def holds(payload):
            if payload:
                return F.rlike("payload", F.concat(F.lit("(?i)"), F.col("r_pattern")))
            return (F.col("r_protocol").isin("ANY") | (F.col("r_protocol") == F.col("protocol"))) & (
                (F.coalesce(F.size("r_dst_port"), F.lit(0)) <= 0) | F.array_contains("r_dst_port", F.col("dst_port")))
        found, ranked = first_hits(packets, signatures, "pattern", ["seq"], True, holds, _signature_condition)
        hit = F.when(F.col("_hit").isNotNull(), F.struct(*[F.col(f"_hit.{n}").alias(n) for n in names], details))
        return _picked(found, ranked, [hit.alias("signature")])
    pick = lambda name, place: F.element_at(F.array(*[F.lit(s[name]) for s in listed]).cast(ArrayType(signatures.schema[name].dataType)), place).alias(name)
    # looked up by a function over the place, which keeps the patterns and the view below in a method short enough to be compiled
    shown = F.transform(F.array("_place"), lambda p: F.struct(*[pick(name, p) for name in names], details))[0]
    return (packets.withColumn("_place", first_of([_signature_condition(s) for s in listed], range(1, len(listed) + 1)).cast("int"))
            .withColumn("signature", F.when(F.col("_place").isNotNull(), shown))
            .drop("_place"))


def match_content(packets: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Add ``content_id, content_action, content_message`` of the first contained text.

    A short table is one expression, one above ``MAX_PATTERNS`` is looked up as :func:`match_signatures` does.
    """
    contents = tables.contents(packets.sparkSession) if contents is None else contents
    shown = {"content_id": "id", "content_action": "action", "content_message": "msg"}
    listed = contents.orderBy("id").limit(MAX_PATTERNS + 1).collect()
    test = lambda r: (F.col("protocol") == r["protocol"]) & F.col("payload").contains(r["content"])
    if len(listed) > MAX_PATTERNS:
        def holds(payload):
            return F.contains("payload", "r_content") if payload else F.col("r_protocol") == F.col("protocol")
        found, ranked = first_hits(packets, contents, "content", ["id"], False, holds, test)
        return _picked(found, ranked, [F.col(f"_hit.{c}").alias(name) for name, c in shown.items()])
    pick = lambda c: F.element_at(F.array(*[F.lit(r[c]) for r in listed]).cast(ArrayType(contents.schema[c].dataType)), F.col("_place"))
    return (packets.withColumn("_place", first_of([test(r) for r in listed], range(1, len(listed) + 1)).cast("int"))
            .withColumns({name: F.when(F.col("_place").isNotNull(), pick(c)) for name, c in shown.items()}).drop("_place"))


def signature_catalogue(detected: DataFrame) -> DataFrame:
    """Matches per category and severity."""
    return (detected.where("signature IS NOT NULL")
            .groupBy(F.col("signature.category").alias("category"), F.col("signature.severity").alias("severity"))
            .agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("signature.sid").alias("signatures")))
