"""Secret scans over an incremental blob ledger (all DataFrame functions).

Every version of every document is content-addressed (SHA-256 of its text).
A ledger table keeps, for each (blob, rule, rule version) that was ever
scanned, the spans found.  A scan

1. addresses all versions and drops the pairs that the ledger holds,
2. reads one text a blob and scans it with the rules still missing,
3. appends the new rows to the ledger, one commit a scan,
4. joins the ledger back to every path that holds a blob.

Copies are scanned once, a changed rule rescans only itself, and an
unchanged corpus scans nothing.  Spans are code points, end exclusive.

Defined results.  A null text counts as empty and has no spans.  Repeated
rows and rows without an id each get the spans of their text.  An empty
table gives an empty result.  Extra columns of ``docs`` stay; the columns
that the operator adds replace existing ones of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from riskframe.llm.base import key_bits, materialise, may_hold, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, non-overlapping)
    whose ``group`` has at least ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: In the order in which spans of equal start are listed.
RULES = [
    Rule("assign", 1, "(?i)((password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 3, 8),
    Rule("access", 1, "(AKIA[A-Z0-9]+)", 1, 16),
    # a run of 32 or more is found whole by either form; this one leaves short runs early
    Rule("hex", 1, "([0-9a-f]{32,})", 1, 32),
]
LEDGER = "blob string, kind string, version int, found array<struct<start:int,end:int>>"


def find_spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start,end>>``: the pieces between matches and the
    matches alternate, so their lengths add up to positions."""
    p = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    match = F.transform(F.regexp_extract_all(text, p, F.lit(1)), F.length)
    value = F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length)
    parts = F.arrays_zip(between.alias("gap"), match.alias("len"), value.alias("val"))
    none = F.expr("array()").cast("array<struct<start:int,end:int,val:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc, x):
        a = acc["at"] + x["gap"]
        b = a + F.coalesce(x["len"], F.lit(0))
        one = F.array(F.struct(a.alias("start"), b.alias("end"), x["val"].alias("val")))
        return F.struct(b.alias("at"), F.when(x["len"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], one)).alias("spans"))
    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    kept = F.transform(F.filter(spans, lambda x: x["val"] >= rule.least), lambda x: F.struct(x["start"], x["end"]))
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.expr("array()").cast("array<struct<start:int,end:int>>"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing is there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split(" ", 1)[0])
                                       for f in LEDGER.split(", ")])


def current(rules: list[Rule]) -> Column:
    """Whether a ledger row is of one of these rules in its version."""
    return reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules],
                  F.lit(False))


def update_ledger(docs: DataFrame, path: str, rules: list[Rule] = RULES, text_col: str = "text") -> None:
    """Scan the unseen (blob, rule version) pairs of ``docs``; append them.

    Blobs that occur once and are new are scanned where their text lies.
    Texts move only if their blob may have copies or be in the ledger, and of
    these only the ones that may still miss a rule; bitmaps tell, and the
    exact join decides."""
    spark = docs.sparkSession
    text = text_of(text_col)
    texts = docs.select(F.sha2(text, 256).alias("blob"), text.alias("_text"))
    seen = read_ledger(spark, path).where(current(rules)).groupBy("blob").agg(F.collect_set("kind").alias("_seen"))
    blobs = texts.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).join(seen, "blob", "left")
    blobs = materialise(blobs, "secret-blobs")
    moved = key_bits(blobs.where("n > 1 or _seen is not null"), F.col("blob"))
    due = may_hold(blobs, moved, "_moved", F.col("blob")).where("_moved").where(
        F.coalesce(F.size("_seen"), F.lit(0)) < len(rules))
    due = materialise(due.select("blob", "_seen"), "secret-due")
    texts = may_hold(texts, moved, "_moved", F.col("blob"))
    texts = may_hold(texts, key_bits(due, F.col("blob")), "_due", F.col("blob"))
    # the first text stands for all copies of a blob; copies in one task meet before the shuffle
    joined = texts.where("_moved and _due").select("blob", "_text").dropDuplicates(["blob"]).join(due, "blob")
    todo = (texts.where("not _moved").select("blob", "_text", F.lit(None).cast("array<string>").alias("_seen"))
            .unionByName(joined.select("blob", "_text", "_seen")))
    rows = [F.when(F.coalesce(F.array_contains("_seen", r.kind), F.lit(False)), None).otherwise(
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find_spans(F.col("_text"), r).alias("found")))
        for r in rules]
    new = (todo.select("blob", F.explode(F.array(*rows)).alias("r")).where("r is not null")
           .select("blob", "r.kind", "r.version", "r.found"))
    new.write.mode("append").parquet(path)


def scan_secrets(docs: DataFrame, path: str, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``blob`` and ``findings``, an array of
    ``struct<start, rank, kind, end>`` in the order of the contract.  Only
    texts whose blob may have findings are moved to join them."""
    docs = docs.drop("blob", "findings")
    update_ledger(docs, path, rules, text_col)
    rank = F.create_map(*[v for i, r in enumerate(rules) for v in (F.lit(r.kind), F.lit(i))])
    ledger = read_ledger(docs.sparkSession, path).where(current(rules) & (F.size("found") > 0))
    hits = (ledger.select("blob", "kind", F.explode("found").alias("s"))
            .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
                F.col("s.start").alias("start"), rank[F.col("kind")].alias("rank"), F.col("kind").alias("kind"),
                F.col("s.end").alias("end")))).alias("findings")))
    hits = materialise(hits, "secret-hits")
    none = F.expr("array()").cast(hits.schema["findings"].dataType)
    paths = may_hold(docs.withColumn("blob", F.sha2(text_of(text_col), 256)), key_bits(hits, F.col("blob")), "_hit", F.col("blob"))
    own = [*[F.col(c) for c in docs.columns], F.col("blob")]
    clean = paths.where("not _hit").select(*own, none.alias("findings"))
    found = paths.where("_hit").join(hits, "blob", "left").select(*own, F.coalesce("findings", none).alias("findings"))
    return clean.unionByName(found)


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced; overlapping ones share a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), gap.alias("out"))
    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(
        findings, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def span_strings(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda s: s["kind"] == kind)).cast("long")
