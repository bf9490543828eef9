"""Secrets in texts, with an incremental ledger of scanned blobs (operator 8).

Every version of every text is addressed by the SHA-256 of its content. The
ledger, a Parquet folder that only grows, holds which rule versions a blob was
scanned with and what was found. A scan reads each distinct blob once and only
with the rule versions that the ledger has not seen for it; findings are then
joined back to all rows (paths, versions) that hold the blob. Raising the version
of a rule makes every blob unseen for that rule alone.

Ledger batches are committed whole by one Spark write, and repeated entries for
one blob are equal, so a scan that was stopped can be run again.

Defined cases: NULL text counts as empty; repeated rows share one blob and are
each reported; NULL ids stay NULL; an empty table gives no rows; other columns
are not read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """A pattern; `group` must have at least `least` characters. `cue` must occur in a text for the rule to match."""

    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    cue: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 20, "AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 0, 24),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0, 0, "PRIVATE KEY-----"),
    Rule("web_token", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 0, 0, "eyJ"),
    Rule("forge_token", 1, r"\bgh[opsur]_[A-Za-z0-9]{36,}", 0, 0, 0, "gh"),
    Rule("chat_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, 0, "xox"),
)

LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,kind:string,start:int,end:int>>"
FINDING = pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find(text: str, rules: tuple[tuple[Rule, re.Pattern], ...]) -> list[dict]:
    """All findings of a text, by start, then rule in the given order."""
    found = []
    for place, (rule, pattern) in enumerate(rules):
        if rule.cue and rule.cue not in text:
            continue
        for m in pattern.finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), place, {"rule": rule.key, "kind": rule.kind, "start": m.start(), "end": m.end()}))
    return [x[2] for x in sorted(found, key=lambda x: x[:2])]


def compiled(rules: tuple[Rule, ...]) -> tuple[tuple[Rule, re.Pattern], ...]:
    return tuple((r, re.compile(r.pattern, r.flags)) for r in rules)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; a new one is made where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def blob_of(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def scan_new_blobs(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan every distinct blob with the rule versions that the ledger lacks for it, and add what was found."""
    spark = docs.sparkSession
    keys = [r.key for r in rules]
    seen = open_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    # equal blobs meet on the map side first, so a group of copies sends one row per task
    blobs = docs.select(blob_of(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(k) for k in keys])
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compiled(rules)
        for batch in batches:
            asked = batch.column("todo").to_pylist()
            found = []
            for text, own in zip(batch.column("text"), asked):
                use = ready if len(own) == len(ready) else tuple(x for x in ready if x[0].key in own)
                found.append(find(text.as_py(), use))
            columns = [batch.column("blob"), pa.array(asked, pa.list_(pa.string())), pa.array(found, pa.list_(FINDING))]
            yield pa.RecordBatch.from_arrays(columns, ["blob", "rules", "findings"])

    new = todo.where(F.size("todo") > 0).select("blob", "text", "todo").mapInArrow(scan, LEDGER)
    new.write.mode("append").parquet(ledger)


def findings_of(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans_col: str = "spans") -> DataFrame:
    """The kept columns of every row with its findings (current rule versions) as `spans_col`, by start, then rule order."""
    spark = docs.sparkSession
    keys = [r.key for r in rules]
    order = F.array(*[F.lit(k) for k in keys])
    entries = open_ledger(spark, ledger).where(F.size("findings") > 0)
    # a blob may have several entries, one per scan that added rule versions
    own = entries.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("findings"))).alias("findings"))
    placed = F.transform(
        F.filter("findings", lambda f: f["rule"].isin(keys)),
        lambda f: F.struct(f["start"].alias("start"), F.array_position(order, f["rule"]).alias("place"), f["kind"].alias("kind"), f["end"].alias("end")),
    )
    spans = F.transform(F.array_sort(placed), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    own = own.select(F.col("blob").alias("__blob"), spans.alias("__spans"))
    rows = docs.select(*keep, blob_of(text_col).alias("__of"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.join(own, F.col("__of") == F.col("__blob"), "left").select(*[rows[c] for c in keep], F.coalesce("__spans", none).alias(spans_col))


def scan_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans_col: str = "spans") -> DataFrame:
    """Bring the ledger up to date with the rows, and give each row its findings."""
    scan_new_blobs(docs, ledger, rules, text_col)
    return findings_of(docs, ledger, rules, text_col, keep, spans_col)


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mask. Spans must be ordered by start."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
                .alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(step["out"], F.substring(text, step["at"] + 1, F.length(text))))
