"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a document is a path to a blob, named by the SHA-256 of its content. The ledger has
the pairs of blob and rule version that were scanned, with what was found. A scan takes the
distinct blobs, drops the pairs that the ledger has, applies the rules that are left, and joins
findings back to all paths of their blob. Rules carry a version, and every finding names the version
that made it: changing one rule scans every blob again for that rule alone, and what an older
version found is no longer reported. The order of rules is that of the report, not of the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` code points or more.

    ``hint`` is a cheaper pattern that every text with a match has.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules come first, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, hint=r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),  # under 20 characters no part of the run can match either
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}", hint="gh[pousr]_"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]{20,})", hint="(?i:bearer)"),
)
RULES = BASE + MORE

SPAN = "struct<start:int,rule:string,kind:string,end:int>"
FOUND = "struct<start:int,rank:int,kind:string,end:int>"
LEDGER = f"blob_id string, rules array<string>, findings array<{SPAN}>"
_MATCHES = "array<struct<rule:string,kind:string,i:int,gap:int,size:int,good:boolean>>"


def _matches(rule: Rule) -> Column:
    """Matches of the rule as an array of structs; gap is the text between a match and the one before."""
    text = F.col("text")
    rx = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, rx, 0).alias("whole"),
        F.regexp_extract_all(text, rx, rule.group).alias("part"),
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
    )
    out = F.transform(
        found,
        lambda m, i: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), F.length(m["whole"]).alias("size"), (F.length(m["part"]) >= rule.least).alias("good")),
    )
    seen = text.rlike(rule.hint or rule.pattern) & F.array_contains("todo", rule.name)
    return F.when(seen, F.filter(out, lambda m: m["size"].isNotNull())).otherwise(F.array().cast(_MATCHES))


def blobs(docs: DataFrame) -> DataFrame:
    """blob_id, text of the distinct contents; a copy goes no further than its first task."""
    return docs.select(_blob_id().alias("blob_id"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob_id").agg(F.first("text").alias("text"))


def _blob_id() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the pairs of blob and rule version that ``ledger`` lacks.

    A row has a blob, the names of the rules that were applied and what they found, which may be
    nothing. A blob whose pairs are all in the ledger gives no row and is not read by any rule.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    docs = documents(docs)
    if ledger is None:
        todo = blobs(docs).withColumn("todo", names)
    else:
        # ids first: texts of blobs whose pairs are all known are not shuffled
        known = ledger.select("blob_id", F.explode("rules").alias("rule")).groupBy("blob_id").agg(F.collect_set("rule").alias("known"))
        asked = docs.select(_blob_id().alias("blob_id")).distinct().join(known, "blob_id", "left")
        asked = asked.select("blob_id", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
        met = docs.withColumn("blob_id", _blob_id()).join(materialize(asked, "unseen"), "blob_id")
        todo = met.groupBy("blob_id").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.first("todo").alias("todo"))
    hints = "|".join(f"(?:{r.hint or r.pattern})" for r in rules)
    found = F.when(F.col("text").rlike(hints), F.concat(*map(_matches, rules)))
    # from here on everything is grouped as the blobs are: no further shuffle, and no text
    rows = todo.select("blob_id", "todo", F.explode_outer(found).alias("m")).select("blob_id", "todo", "m.*")
    before = Window.partitionBy("blob_id", "rule").orderBy("i")
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "kind", "end").cast(SPAN)
    return ends.groupBy("blob_id").agg(F.first("todo").alias("rules"), F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("findings"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob_id and findings (start, rank, kind, end) of every path, from the ledger; by start, then by the order of the rules, base kinds first.

    Findings of rule versions that are not in ``rules`` are left out. Few blobs have findings, and
    only those are joined; a blob with very many paths is one whose partition AQE splits.
    """
    listed = {r.kind: i for i, r in enumerate(BASE)}
    ordered = sorted(rules, key=lambda r: listed.get(r.kind, len(BASE)))
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(ordered) for x in (r.name, i)))
    hit = ledger.filter(F.size("findings") > 0).select("blob_id", F.explode("findings").alias("f")).withColumn("rank", rank[F.col("f.rule")])
    found = F.struct("f.start", "rank", "f.kind", "f.end").cast(FOUND)
    per_blob = hit.filter("rank is not null").groupBy("blob_id").agg(F.array_sort(F.collect_set(found)).alias("findings"))
    paths = documents(docs).select("doc_id", _blob_id().alias("blob_id"))
    return paths.join(per_blob, "blob_id", "left").select("doc_id", "blob_id", F.coalesce("findings", F.array().cast(f"array<{FOUND}>")).alias("findings"))


def secret_report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``.

    The base rules' spans are ``kind:start:end`` in code points, end exclusive, by start and then by
    rule order, comma-joined; ``spans`` has all rules' spans. Null text counts as empty and has none.
    A null doc_id stays null, rows that repeat a doc_id are reported each; other columns are not read.
    """
    new = materialize(scan(docs, ledger, rules), "ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    found = findings(docs, whole, rules)
    text = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
