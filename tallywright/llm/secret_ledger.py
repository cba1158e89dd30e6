"""Secret scans over a blob ledger.

Every version of every document is addressed by the digest of its content. A ledger remembers which
(blob, rule version) pairs were scanned and what was found, so a scan reads only what is new: unseen
blobs, or known blobs under a new version of a rule. Findings go back to all paths that hold the blob.

Positions come from regular-expression functions of the engine: ``split`` gives the texts between the
matches and ``regexp_extract_all`` the matches, both in order, so a running sum of lengths places them.
Everything here is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import free_name, stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; kept if ``group`` has ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    probe: str | None = None  # a cheaper pattern that every kept match contains

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


# The three base kinds, in their order.
BASE = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
# Further credential formats.
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[oprsu]_[A-Za-z0-9]{30,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@\"'<>]{1,100}:[^\x20\x09-\x0D/:@\"'<>]{3,100}@"),
)

LEDGER = "blob binary, scanned array<string>, found array<struct<start:int,rank:int,rule:string,stop:int>>"


def addressed(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``path, text, blob`` of every version; a null text is the empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("blob"))


def _matches(rule: Rule, rank: int, wanted: Column) -> Column:
    """The matches of a rule in ``text``: what stands before each, its length, and whether it is kept."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.split("text", rule.pattern, -1)
    groups = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else hits
    rows = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"), groups.alias("part")),
        lambda m, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("number"), F.char_length(m["gap"]).alias("gap"), F.char_length(m["hit"]).alias("size"), (F.char_length(m["part"]) >= rule.least).alias("kept")
        ),
    )
    none = F.array().cast("array<struct<rank:int,number:int,gap:int,size:int,kept:boolean>>")
    return F.when(wanted & F.col("text").rlike(rule.probe or rule.pattern), rows).otherwise(none)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one for each blob with a rule version not scanned yet."""
    one = versions.groupBy("blob").agg(F.min(F.coalesce(F.col("path"), F.lit(-(2**63)))).alias("path"))
    labels = F.array(*(F.lit(r.label) for r in rules))
    if ledger is None:
        todo = one.withColumn("todo", labels)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
        todo = one.join(seen, "blob", "left").withColumn("todo", F.array_except(labels, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0).drop("seen")
    # one version stands for all that hold the blob
    todo = todo.withColumnsRenamed({"blob": "todo_blob", "path": "todo_path"})
    here = F.coalesce(F.col("path"), F.lit(-(2**63)))
    texts = versions.join(todo.hint("shuffle_hash"), (here == F.col("todo_path")) & (F.col("blob") == F.col("todo_blob")))
    found = F.concat(*(_matches(rule, rank, F.array_contains("todo", rule.label)) for rank, rule in enumerate(rules)))
    rows = texts.select("blob", "todo", F.explode_outer(found).alias("m")).select("blob", "todo", "m.*").dropDuplicates(["blob", "rank", "number"])
    upto = Window.partitionBy("blob", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    name = F.element_at(F.array(*(F.lit(r.label) for r in rules)), F.col("rank") + 1)
    placed = rows.repartition("blob").select("blob", "todo", "rank", "kept", (stop - F.col("size")).cast("int").alias("start"), name.alias("rule"), stop.cast("int").alias("stop"))
    return placed.groupBy("blob").agg(
        F.first("todo").alias("scanned"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("start", "rank", "rule", "stop")))).alias("found"),
    )


def extend_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with all of ``versions`` in it; new rows are stored in the shared folder."""
    new = stored(scan_unseen(versions, ledger, rules), "blob-ledger")
    return new if ledger is None else ledger.unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, blob, found`` of every version: spans of the given rule versions, by start and then rule."""
    spans = ledger.where(F.size("found") > 0).select("blob", F.explode("found").alias("s"))
    spans = spans.where(F.col("s.rule").isin([r.label for r in rules])).groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("found"))
    return versions.select("path", "blob").join(spans, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,rule:string,stop:int>>")))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.substring_index(s["rule"], "@", 1), s["start"], s["stop"])), ",")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``doc_id, text``.

    A null text is empty and has no findings; a null ``doc_id`` stays null; every repeated row is
    reported while its text is scanned once; other columns are not read; an empty table gives no rows.
    Spans count code points, the end is exclusive; spans of different rules may overlap.
    """
    versions = addressed(docs)
    found = findings(versions, extend_ledger(versions, ledger, rules), rules)
    base = F.filter("found", lambda s: s["rule"].isin([r.label for r in BASE]))
    count = lambda r: F.size(F.filter("found", lambda s: s["rule"] == r.label)).cast("long").alias(f"n_{r.name}")
    return found.select(
        F.col("path").alias("doc_id"), *(count(r) for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every found span replaced by ``mark``; ``n_chars``, where there is one, follows.

    Other columns and rows stay as they are; a null text stays null.
    """
    versions = addressed(docs)
    ledger = extend_ledger(versions, None, rules)
    spans = ledger.where(F.size("found") > 0).select("blob", F.explode("found").alias("s")).select("blob", "s.*").distinct()
    before = Window.partitionBy("blob").orderBy("start", "stop", "rank").rowsBetween(Window.unboundedPreceding, -1)
    parts = spans.withColumn("from", F.coalesce(F.max("stop").over(before), F.lit(0)))
    # text from the end of all earlier spans up to this one; a span inside an earlier one adds nothing
    parts = parts.where(F.col("stop") > F.col("from")).withColumn("fresh", F.col("start") >= F.col("from"))
    cuts = parts.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "from", "fresh", "stop"))).alias("cuts"), F.max("stop").alias("tail"))
    # the documents' own columns keep their names, whatever they are: the cuts come in as one column of a free name
    blob, found, names = free_name(docs, "blob_key"), free_name(docs, "blob_cuts"), docs.columns
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    marked = cuts.select(F.col("blob").alias(blob), F.struct("cuts", "tail").alias(found))
    joined = docs.withColumn(blob, key).join(marked, blob, "left")
    pieces, none = F.col(found)["cuts"], F.col(found).isNull()
    kept = F.transform(pieces, lambda c: F.when(c["fresh"], F.concat(F.substring("text", c["from"] + 1, c["start"] - c["from"]), F.lit(mark))).otherwise(""))
    text = F.when(none, F.col("text")).otherwise(F.concat(F.array_join(kept, ""), F.substring("text", F.col(found)["tail"] + 1, F.char_length("text"))))
    out = joined.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
