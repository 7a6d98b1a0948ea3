"""Packet verdicts of the intrusion detector: blocked source, signature, rate, pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vigil import fixed
from vigil.operators.rules import match_signatures
from vigil.operators.thresholds import SECOND, first_distinct_fire, first_fire
from vigil.session import durable

FLOOD, FLOOD_WINDOW = fixed.SYN_FLOOD
SCAN, SCAN_WINDOW = fixed.IDS_PORT_SCAN
PIECE_SECONDS = 3600
# A piece may begin with its source free since up to SCAN_WINDOW seconds earlier (longer makes no
# difference) or blocked for up to the longest block, rounded up to a whole second.
ENTRIES = range(-SCAN_WINDOW, fixed.SYN_FLOOD_BLOCK + 2)


def rate_rows(signed: DataFrame) -> DataFrame:
    """Packets that count for the rates: bare SYN, no signature hit, known source."""
    return signed.where((F.col("flags") == "SYN") & F.col("signature").isNull()
                        & (F.coalesce("src_ip", F.lit("")) != ""))


def syn_floods(rows: DataFrame) -> DataFrame:
    """First flood per source."""
    return first_fire(rows, "src_ip", FLOOD, FLOOD_WINDOW * SECOND, event_id="packet_id")


def port_scans(rows: DataFrame) -> DataFrame:
    """First port scan per source."""
    return first_distinct_fire(rows.where(F.col("dst_port") != 0), "src_ip", "dst_port", SCAN,
                               SCAN_WINDOW * SECOND, event_id="packet_id")


class _Piece:
    """Sorted rate rows of one source and hour (and the half minute before), ready to be replayed."""

    def __init__(self, pdf: pd.DataFrame, start: int):
        pdf = pdf.sort_values(["us", "packet_id"])
        self.us = pdf["us"].to_numpy()
        self.ids = pdf["packet_id"].to_numpy()
        self.start, self.end = start, start + PIECE_SECONDS * SECOND
        self.own = int(np.searchsorted(self.us, start))
        flood = np.zeros(len(self.us), dtype=bool)
        if len(self.us) >= FLOOD:
            flood[FLOOD - 1:] = self.us[FLOOD - 1:] - self.us[:len(self.us) - FLOOD + 1] <= FLOOD_WINDOW * SECOND
        self.floods = np.flatnonzero(flood)
        self.scan_from = self._latest_starts(pdf["dst_port"].to_numpy())

    def _latest_starts(self, ports: np.ndarray) -> np.ndarray:
        """For every row the latest row to start at and still see enough ports; -1 when there is none."""
        out = np.full(len(ports), -1, dtype=np.int64)
        last: dict[int, int] = {}
        best = -1
        for i, port in enumerate(ports):
            if port:
                last.pop(port, None)
                last[port] = i                  # ordered by last occurrence
                if len(last) >= SCAN:
                    at = list(last.values())[-SCAN]
                    if self.us[i] - self.us[at] <= SCAN_WINDOW * SECOND:
                        best = max(best, at)
                    if len(last) > 4 * SCAN:    # older ports cannot matter again
                        last = dict(list(last.items())[-SCAN:])
            out[i] = best
        return out

    def exits(self) -> list[int]:
        """What the piece hands on for every entry value; entries that skip the same rows share a replay."""
        known, out = {}, []
        for entry in ENTRIES:
            free = self.start + entry * SECOND
            first = int(np.searchsorted(self.us, free))
            if first not in known:
                fires, leave = self.replay(entry)
                known[first] = leave if fires else None
            leave = known[first]
            out.append(int(max((free - self.end) // SECOND, ENTRIES[0])) if leave is None else leave)
        return out

    def replay(self, entry: int):
        """Fires of the piece when its source is free from ``entry`` seconds after the start on.

        Returns the fires and the entry value handed to the next piece.
        """
        free = self.start + entry * SECOND
        fires = []
        while True:
            first = int(np.searchsorted(self.us, free))
            k = int(np.searchsorted(self.floods, max(first + FLOOD - 1, self.own)))
            flood = int(self.floods[k]) if k < len(self.floods) else len(self.us)
            scan = max(int(np.searchsorted(self.scan_from, first)), self.own) if len(self.us) else 0
            at = min(flood, scan)
            if at >= len(self.us):
                return fires, int(max((free - self.end) // SECOND, ENTRIES[0]))
            ttl = fixed.SYN_FLOOD_BLOCK if flood <= scan else fixed.IDS_PORT_SCAN_BLOCK
            whole = -(-int(self.us[at]) // SECOND) * SECOND
            free = whole + ttl * SECOND
            fires.append((int(self.us[at]), int(self.ids[at]), "flood" if flood <= scan else "scan", free))
            if free >= self.end:
                return fires, int((free - self.end) // SECOND)


def blocks(signed: DataFrame) -> DataFrame:
    """Blocks set by the rate checks: source, firing packet, kind and end.

    A block ends on a whole second.  Three reductions come before any sequence is replayed: only
    the first twenty rows of a source and second (the twentieth fires if none did before, and while
    a source is blocked nothing counts; these rows are written down once), only sources that can
    fire at all, and hours instead of whole histories.  An hour hands on nothing but the second from which its source is free, so
    every hour tabulates that for each second it may receive, the tables are chained per source,
    and the hours report their fires.
    """
    rows = rate_rows(signed).select("src_ip", "us", "packet_id", "dst_port")
    slot = Window.partitionBy("src_ip", "_slot").orderBy("us", "packet_id")
    few = durable(rows.withColumn("_slot", F.floor(F.col("us") / SECOND).cast("bigint"))
                  .withColumn("_n", F.row_number().over(slot)).where(F.col("_n") <= FLOOD).drop("_n"))
    suspects = syn_floods(few).select("src_ip").unionByName(port_scans(few).select("src_ip")).distinct()
    few = few.join(suspects, "src_ip", "left_semi")
    # rows of the last seconds of an hour also go to the next one
    here = F.floor(F.col("_slot") / PIECE_SECONDS).cast("bigint")
    late = F.col("_slot") % PIECE_SECONDS >= PIECE_SECONDS - SCAN_WINDOW - 1
    pieces = few.withColumn("piece", F.explode(F.when(late, F.array(here, here + 1)).otherwise(F.array(here)))).drop("_slot")

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf["piece"].iloc[0])
        rows = _Piece(pdf, piece * PIECE_SECONDS * SECOND)
        return pd.DataFrame({"src_ip": [pdf["src_ip"].iloc[0]], "piece": [piece],
                             "exits": [rows.exits()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        entries, entry, previous = [], ENTRIES[0], None
        for piece, exits in zip(pdf["piece"], pdf["exits"]):
            if previous is not None and piece != previous + 1:
                entry = ENTRIES[0]
            entries.append(entry)
            entry = ENTRIES[0] if exits is None else int(exits[entry - ENTRIES[0]])
            previous = piece
        return pd.DataFrame({"src_ip": pdf["src_ip"], "piece": pdf["piece"], "entry": entries})

    def fires(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf["piece"].iloc[0])
        found, _ = _Piece(pdf, piece * PIECE_SECONDS * SECOND).replay(int(pdf["entry"].iloc[0]))
        out = pd.DataFrame(found, columns=["fire_us", "fire_id", "kind", "until_us"])
        out.insert(0, "src_ip", pdf["src_ip"].iloc[0])
        return out

    # only an hour directly followed by another of its source hands anything on
    keys = pieces.select("src_ip", "piece").distinct()
    following = F.lead("piece").over(Window.partitionBy("src_ip").orderBy("piece"))     # a row per hour
    handing = keys.withColumn("_next", following).where(F.col("_next") == F.col("piece") + 1).drop("_next")
    tables = (pieces.join(handing, ["src_ip", "piece"], "left_semi").groupBy("src_ip", "piece")
              .applyInPandas(table, "src_ip string, piece bigint, exits array<bigint>"))
    entries = (keys.join(handing.select("src_ip").distinct(), "src_ip", "left_semi")
               .join(tables, ["src_ip", "piece"], "left").groupBy("src_ip")
               .applyInPandas(chain, "src_ip string, piece bigint, entry bigint"))
    # little data, much work per group: keep the full number of tasks
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pieces.join(entries, ["src_ip", "piece"], "left").fillna(ENTRIES[0], ["entry"])
            .repartition(tasks, "src_ip", "piece").groupBy("src_ip", "piece")
            .applyInPandas(fires, "src_ip string, fire_us bigint, fire_id bigint, kind string, until_us bigint"))


_CELL = (fixed.SYN_FLOOD_BLOCK + 1) * SECOND


def _cell(us):
    return F.floor(us / F.lit(_CELL)).cast("bigint")


def verdicts(packets: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Add the verdict of every packet: ``matched, action, severity, rule_name, rule_sid, category, mitre, details``."""
    signed = match_signatures(packets, signatures)
    spans = blocks(signed)
    # a block touches at most two cells, a packet at most one block
    spans = (spans.withColumn("_cell", F.explode(F.sequence(_cell(F.col("fire_us")), _cell(F.col("until_us")))))
             .withColumnRenamed("src_ip", "_ip"))
    at = F.struct(F.col("us"), F.col("packet_id"))
    fire = F.struct(F.col("fire_us").alias("us"), F.col("fire_id").alias("packet_id"))
    joined = (signed.withColumn("_here", _cell(F.col("us")))
              .join(spans, (F.col("src_ip") == F.col("_ip")) & (F.col("_here") == F.col("_cell"))
                    & (at >= fire) & (F.col("us") < F.col("until_us")), "left"))
    flood = F.col("kind") == "flood"
    hit = F.col("kind").isNotNull()
    fired = hit & (F.col("fire_id") == F.col("packet_id")) & (F.col("fire_us") == F.col("us"))
    blocked = hit & ~fired
    sig = F.col("signature")
    reason = F.when(flood, "SYN Flood detected").otherwise("Port scan detected")

    def pick(on_block, on_flood, on_scan, field, otherwise):
        lit = lambda x: x if not isinstance(x, (str, int)) else F.lit(x)
        return (F.when(blocked, lit(on_block)).when(fired, F.when(flood, lit(on_flood)).otherwise(lit(on_scan)))
                .when(sig.isNotNull(), sig[field]).otherwise(lit(otherwise)))

    source = lambda *parts: F.concat(*[F.lit(p) if p != "src_ip" else F.col(p) for p in parts])
    out = joined.withColumns({
        "matched": hit | sig.isNotNull(),
        "verdict": pick("drop", "drop", "alert", "action", "pass"),
        "severity": pick("Critical", "Critical", "High", "severity", ""),
        "rule_name": pick("IP Blocked", "SYN Flood Detected", "Port Scan Detected", "name", ""),
        "rule_sid": pick(0, 9001, 9002, "sid", 0),
        "category": pick("", "DoS", "Reconnaissance", "category", ""),
        "mitre": pick("", "T1498.001", "T1046", "mitre", ""),
        "details": pick(F.concat(F.lit("Source IP "), "src_ip", F.lit(" is currently blocked: "), reason),
                        source("Excessive SYN packets from ", "src_ip"),
                        source("Port scan from ", "src_ip", f": {SCAN} unique ports"), "details", "")})
    return out.select(*packets.columns, "matched", F.col("verdict").alias("action"), "severity", "rule_name", "rule_sid",
                      "category", "mitre", "details")


def alert_records(judged: DataFrame) -> DataFrame:
    """Recorded alerts: matches other than packets of an already blocked source."""
    return (judged.where(F.col("matched") & (F.col("rule_name") != "IP Blocked"))
            .select("packet_id", "us", "action", "severity", "rule_name", "rule_sid", "category", "mitre", "details",
                    "src_ip", "dst_ip", "dst_port", "protocol"))


def counters(judged: DataFrame) -> DataFrame:
    sid = F.col("rule_sid")
    dropped = F.col("rule_name") == "IP Blocked"
    return judged.agg(F.count(F.lit(1)).alias("packets_analyzed"),
                      F.count_if(F.col("matched") & ~dropped).alias("alerts_generated"),
                      F.count_if((sid > 0) & (sid < 9000)).alias("signature_matches"),
                      F.count_if(sid > 9000).alias("rate_alerts"), F.count_if(dropped).alias("packets_dropped"))


def active_blocks(spans: DataFrame, as_of_us: int) -> DataFrame:
    """Blocks in force at a moment with the whole seconds that remain."""
    left = F.floor((F.col("until_us") - F.lit(as_of_us)) / SECOND).cast("bigint")
    return (spans.where((F.col("fire_us") <= as_of_us) & (left > 0))
            .select("src_ip", F.when(F.col("kind") == "flood", "SYN Flood detected").otherwise("Port scan detected")
                    .alias("reason"), F.col("fire_us").alias("blocked_at_us"), left.alias("ttl_remaining")))


def apply_block_list(packets: DataFrame, detections: DataFrame, ttl_seconds: int = fixed.STANDALONE_BLOCK) -> DataFrame:
    """Add ``blocked``: a detection of the source lies less than the ban time back.

    With cells as long as the ban, a cell is blocked from its first detection on, and up to one ban
    after the last detection of the cell before: two values per source and cell, combined before
    the shuffle.
    """
    ttl = ttl_seconds * SECOND
    cell = lambda: F.floor(F.col("us") / ttl).cast("bigint")
    ends = (detections.groupBy(F.col("src_ip").alias("_ip"), cell().alias("_c"))
            .agg(F.min("us").alias("_first"), F.max("us").alias("_last")))
    same = ends.select("_ip", "_c", "_first")
    before = ends.select(F.col("_ip").alias("_ip2"), (F.col("_c") + 1).alias("_c2"), "_last")
    rows = packets.withColumn("_here", cell())
    out = (rows.join(same, (F.col("src_ip") == F.col("_ip")) & (F.col("_here") == F.col("_c")), "left")
           .join(before, (F.col("src_ip") == F.col("_ip2")) & (F.col("_here") == F.col("_c2")), "left"))
    blocked = (F.coalesce(F.col("us") >= F.col("_first"), F.lit(False))
               | F.coalesce(F.col("us") < F.col("_last") + ttl, F.lit(False)))
    return out.withColumn("blocked", blocked).drop("_here", "_ip", "_c", "_first", "_ip2", "_c2", "_last")
