"""Personal data: exact base patterns, and contextual patterns bootstrapped from what those find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import SPACE, SPACES, before, let, stored, text_of, words_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENCE = 0.8
SUPPORT = 3
LONGEST = 64
CONTEXT = 80

#: Possessive quantifiers and the guards in front find the same leftmost matches as the plain forms in
#: one pass without recursion, also in texts without any white space.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORTH = {"email": "@", "ip": ".", "card": "", "phone": "+"}
MARKS = "#*$%&|<>!?,;:\"'."
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"

SPAN = "array<struct<kind:int,start:int,end:int>>"


def positions(text: Column, pattern: str) -> Column:
    """All matches, leftmost first and apart: start, end (code points), text, and the text in front."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                    F.split(text, pattern, -1).alias("gaps"))

    def placed(b):
        sizes = F.transform(b["found"], lambda m, i: F.length(m) + F.length(F.get(b["gaps"], i)))
        return let(before(sizes, lambda x, y: x + y), lambda at: F.transform(b["found"], lambda m, i: F.struct(
            (F.get(at, i) + F.length(F.get(b["gaps"], i))).alias("start"),
            (F.get(at, i) + F.length(F.get(b["gaps"], i)) + F.length(m)).alias("end"),
            m.alias("text"), F.get(b["gaps"], i).alias("gap"))))
    return let(both, placed)


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        def small(part):
            bare = F.regexp_replace(part, "^0+", "")
            return F.when(bare == "", F.lit(True)).otherwise(
                F.coalesce(bare.try_cast("decimal(38,0)") <= 255, F.lit(False)))
        return F.forall(F.split(text, r"\."), small)
    if kind == "card":
        def luhn(digits):
            turned = F.reverse(digits)
            values = F.transform(F.sequence(F.lit(1), F.length(digits)),
                                 lambda i: F.substring(turned, i, F.lit(1)).try_cast("int"))
            doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
            return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0
        return let(F.regexp_replace(text, "[ -]", ""),
                   lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _spans(found: Column, kind: str, number: int) -> Column:
    return F.transform(F.filter(found, lambda m: _valid(kind, m["text"])), lambda m: F.struct(
        F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).cast(SPAN)


def base_spans(text: Column) -> Column:
    """Base spans of all kinds: array of (kind as index into KINDS, start, end), by kind, then start."""
    out = []
    for number, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(WORTH[kind])) if WORTH[kind] else F.lit(True)
        spans = _spans(positions(text, PATTERNS[kind]), kind, number)
        out.append(F.when(hint & text.rlike("[0-9@]"), spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*out)


# ---------------------------------------------------------------- contextual extraction

def _general(word: Column) -> Column:
    """A context word in general form: lower case, marks dropped, digits as 9."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[#*$%&|<>!?,;\"']+", ""), "[0-9]", "9")


def candidates(text: Column, spans: Column) -> Column:
    """Words with a digit or @: place of their core, context in front, shape, and the kind of a base span met.

    The context is the word in front of it; the shape has 9 for every digit and a for every run of letters.
    """
    def one(found):
        def entry(m, i):
            front = F.when(F.btrim(m["gap"], F.lit(SPACES)) == "", F.get(found, i - 1)["text"]).otherwise(F.try_element_at(
                words_of(F.right(m["gap"], F.lit(CONTEXT))), F.lit(-1)))
            core = F.btrim(m["text"], F.lit(MARKS))
            lead = F.length(m["text"]) - F.length(F.ltrim(m["text"], F.lit(MARKS)))
            return F.struct((m["start"] + lead).alias("start"), (m["start"] + lead + F.length(core)).alias("end"),
                            _general(F.coalesce(front, F.lit(""))).alias("context"), F.lower(core).alias("instance"))

        def known(c):
            met = F.filter(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
            shape = F.regexp_replace(F.regexp_replace(c["instance"], r"\p{L}+", "a"), "[0-9]", "9")
            return F.struct(c["start"], c["end"], c["context"], c["instance"], shape.alias("shape"),
                            F.coalesce(F.get(met, F.lit(0))["kind"], F.lit(-1)).alias("kind"))
        cores = F.transform(F.filter(F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
                                     lambda x: F.length(x["m"]["text"]) <= LONGEST), lambda x: entry(x["m"], x["i"]))
        return F.transform(F.filter(cores, lambda c: c["end"] > c["start"]), known)
    return F.when(text.rlike("[0-9@]"), let(positions(text, CANDIDATE), one))


def _searched(text: Column) -> Column:
    """Base spans and candidates of one text."""
    def both(t):
        return let(base_spans(t), lambda spans: F.struct(spans.alias("base"), candidates(t, spans).alias("found")))
    return let(text, both)


def confident_patterns(uses: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE,
                       support: int = SUPPORT) -> DataFrame:
    """(context, shape, found): patterns that name a kind, from ``uses`` (context, shape, instance, kind).

    Instances met by a base span are seeds with confidence one.  In every round a pattern's score for a
    kind is the mean confidence of its instances, and patterns with at least ``support`` confident
    instances and a score of ``confidence`` or more hand their score to their other instances.
    """
    edges = stored(uses.groupBy("context", "shape", "instance").agg(
        F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")))
    seeds = edges.where(F.col("kind") >= 0).groupBy("instance").agg(F.max("kind").alias("found")).withColumn(
        "score", F.lit(1.0))
    known, good = stored(seeds), None
    sizes = edges.groupBy("context", "shape").agg(F.count(F.lit(1)).alias("all"))
    for _ in range(rounds):
        scored = (edges.join(known, "instance").groupBy("context", "shape", "found")
                  .agg(F.sum("score").alias("mass"), F.count(F.when(F.col("score") >= confidence, 1)).alias("sure")))
        good = stored(scored.join(sizes, ["context", "shape"])
                      .withColumn("score", F.col("mass") / F.col("all"))
                      .where((F.col("score") >= confidence) & (F.col("sure") >= support))
                      .groupBy("context", "shape").agg(F.max_by("found", "score").alias("found"), F.max("score").alias("score")))
        fresh = (edges.join(good, ["context", "shape"]).select("instance", "found", "score")
                 .unionByName(known))
        known = stored(fresh.groupBy("instance").agg(F.max_by("found", F.struct("score", "found")).alias("found"),
                                                     F.max("score").alias("score")))
    return good.select("context", "shape", "found")


def find(docs: DataFrame, keep_rows: bool = False, **options) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs``; spans are arrays of (kind, start, end).

    ``base`` are the exact patterns' spans, by kind and start; ``spans`` has them and those that confident
    patterns add, which meet no base span.  Offsets count code points, ends are exclusive.  Null text is
    empty and has no spans; repeated rows are searched one by one; extra columns come along only with
    ``keep_rows``, as the struct ``row``.  Words above 64 characters teach and find no context.
    """
    rows = docs.select("doc_id", text_of().alias("_t"), *([F.struct("*").alias("row")] if keep_rows else []))
    rows = rows.select("*", F.inline(F.array(_searched(F.col("_t"))))).drop("_t")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    uses = rows.select("_row", F.explode("found").alias("c")).select("_row", "c.*")
    good = confident_patterns(uses, **options)
    more = (uses.where(F.col("kind") < 0).join(good, ["context", "shape"])
            .groupBy("_row").agg(F.collect_list(F.struct(F.col("found").alias("kind"), "start", "end")).alias("added")))
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return rows.drop("found").join(more, "_row", "left").select(
        "doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(spans).alias("spans"),
        *(["row"] if keep_rows else []))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first by start stays."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def parts(o):
        ends = before(F.transform(o, lambda s: s["end"]), F.greatest)
        pieces = let(ends, lambda at: F.transform(o, lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(
            F.substring(text, F.get(at, i) + 1, s["start"] - F.get(at, i)), F.element_at(names, s["kind"] + 1))).otherwise("")))
        rest = F.substring(text, F.array_max(F.transform(o, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), rest)
    joined = let(ordered, parts)
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def mask(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, and n_chars counted anew if there is one."""
    found = find(docs, keep_rows=True, **options).select("row.*", F.col("spans").alias("_spans"))
    text = F.when(F.size("_spans") > 0, masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    out = found.withColumn("text", text).drop("_spans")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)
