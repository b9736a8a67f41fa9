"""Secret scans with an incremental ledger of blobs.

Every historical version of every path is addressed by its content: equal texts,
wherever and whenever they stood, are one blob. The ledger is a Parquet table in a
shared folder with one row for each blob of a run: which rules (each named by a
digest of its definition, its rule version) have looked at it and what they found.
A run scans only pairs of a blob and a rule version that the ledger does not have,
appends them, and joins the findings back to all paths by the blob.

How a run finds its work without moving texts: a first pass keeps path columns and
blob ids only. Blobs that stand there more than once or that the ledger knows are
special; a bounded Bloom filter over them sends all other rows, which are unseen and
single for certain, straight to the scan. A second filter holds the special blobs that
still need a rule and the single ones that the first filter took for special; what is
in the first and not in the second has been scanned before and is skipped. Only the
rest, once per blob and task, is shuffled by blob, met exactly with what it still
needs, and scanned once. A full filter sends more rows that way and changes no result.

A blob's ledger row is self-contained and depends on its text alone, so a run that
broke off while appending, or two runs at once, leave at worst equal rows, which
count once.

Defined cases: null text is the empty text; null path columns are values like others;
repeated rows of one path and text give a result row each; an empty table gives an
empty result and leaves the ledger as it is; other columns are left out. Positions
are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import membership
from .shared import new_path, staged

LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"
SLICE_ROWS = 512


def either_case(word: str) -> str:
    """A pattern for an ASCII word with its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping, whose `group` has `least` code points or more.

    `literals`: lower-case strings of which a text must hold one, lower-cased, to have any
    match (none: no such test). They speed the scan up and do not belong to the version.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    literals: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        """Names the rule by its definition: a changed rule is another version."""
        return hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group)).encode()).hexdigest()[:16]


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"
BASE = (
    Rule(
        "assign",
        rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
        literals=("password", "passwd", "secret", "token", "api_key", "apikey"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, literals=("akia",)),
    # runs of 24 and more: the same spans as all runs without the shorter ones
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
# Token formats that say by their prefix what they are.
ADDED = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40, literals=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", literals=("private key-----",)),
)


def spans(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Start and end of each match of the rule that is long enough."""
    out = []
    for m in compiled.finditer(text):
        a, b = m.span(rule.group)
        if b - a >= rule.least:
            out.append(m.span())
    return out


def blob_of(text: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 text (32 bytes); null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class BlobLedger:
    """The table of scanned (blob, rule version) pairs and their findings under `path`."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or new_path(spark, "ledger")
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select("blob", "rules", "findings").write.mode("append").parquet(self.path)

    def seen(self) -> DataFrame:
        """(blob, seen): the rule versions that have looked at each blob."""
        return self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """(blob, findings): blobs where a rule found something, by start, then in the order of `rules`."""
        versions = [r.version for r in rules]
        place = F.array_position(F.array(*map(F.lit, versions)), F.col("f.rule")) - 1
        found = (
            self.rows()
            .filter(F.size("findings") > 0)
            .select("blob", F.explode("findings").alias("f"))
            .filter(F.col("f.rule").isin(versions))
            .select("blob", F.col("f.start").alias("start"), place.alias("place"), F.col("f.end").alias("end"))
            .distinct()
        )
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        return (
            found.groupBy("blob")
            .agg(F.sort_array(F.collect_list(F.struct("start", "place", "end"))).alias("all"))
            .select(
                "blob",
                F.transform(
                    "all",
                    lambda f: F.struct(
                        F.get(kinds, f["place"].cast("int")).alias("kind"), f["start"].alias("start"), f["end"].alias("end")
                    ),
                ).alias("findings"),
            )
        )


FOUND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scanner(rules: Sequence[Rule]):
    """look(text, wanted versions): findings of a text as dictionaries."""
    tools = [(r, r.version, re.compile(r.pattern, re.ASCII)) for r in rules]

    def look(text: str, wanted: set[str] | None = None) -> list[dict]:
        lower = text.lower()
        out = []
        for rule, version, compiled in tools:
            if wanted is not None and version not in wanted:
                continue
            if rule.literals and not any(w in lower for w in rule.literals):
                continue
            out.extend({"rule": version, "start": a, "end": b} for a, b in spans(text, rule, compiled))
        return out

    return look


def _scan_or_send(rules: Sequence[Rule]):
    """Rows that are certainly unseen are scanned; the text of others is sent on, once for each blob of the task."""
    versions = [r.version for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, sent = _scanner(rules), set()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):  # few texts are unpacked at a time
                batch = whole.slice(start, SLICE_ROWS)
                out: dict[str, list] = {"blob": [], "text": [], "rules": [], "findings": []}
                rows = zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "direct")))
                for blob, text, direct in rows:
                    if not direct:
                        if blob in sent:
                            continue
                        sent.add(blob)
                    out["blob"].append(blob)
                    out["text"].append(None if direct else text or "")
                    out["rules"].append(versions if direct else None)
                    out["findings"].append(look(text or "") if direct else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["blob"], pa.binary()),
                        pa.array(out["text"], pa.string()),
                        pa.array(out["rules"], pa.list_(pa.string())),
                        pa.array(out["findings"], FOUND),
                    ],
                    names=list(out),
                )

    return run


def _scan_needed(rules: Sequence[Rule]):
    """Scan each text by the rules in `todo`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _scanner(rules)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                todo = batch.column("todo")
                found = [look(t, set(w)) for t, w in zip(batch.column("text").to_pylist(), todo.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("blob"), todo.cast(pa.list_(pa.string())), pa.array(found, FOUND)],
                    names=["blob", "rules", "findings"],
                )

    return run


def scan(
    versions: DataFrame,
    ledger: BlobLedger,
    rules: Sequence[Rule] = BASE + ADDED,
    path_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """`path_cols`, blob (hex) and findings (kind, start, end) of every row of `versions`.

    Only pairs of a blob and a rule version that `ledger` lacks are scanned; they are in it afterwards.
    """
    wanted = F.array(*[F.lit(r.version) for r in rules])
    named = versions.select(*[F.col(f"`{c}`") for c in path_cols], blob_of(F.col(f"`{text_col}`")).alias("__blob"))
    paths = staged(named, "paths")
    blobs = (
        paths.groupBy(F.col("__blob").alias("blob"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(ledger.seen(), "blob", "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        .select("blob", ((F.col("n") > 1) | F.col("seen").isNotNull()).alias("special"), "todo")
    )
    blobs = staged(blobs, "blobs")
    special = blobs.filter("special").select("blob", "todo")
    is_special = membership(special, "blob")
    doubted = special.filter(F.size("todo") > 0).select("blob").unionByName(
        blobs.filter(~F.col("special")).filter(is_special("blob")).select("blob")
    )
    may_need = membership(staged(doubted, "doubted"), "blob")

    texts = versions.select(blob_of(F.col(f"`{text_col}`")).alias("blob"), F.col(f"`{text_col}`").alias("text"))
    tested = texts.withColumns({"direct": ~is_special("blob"), "needed": may_need("blob")}).filter("direct or needed")
    first = staged(
        tested.select("blob", "text", "direct").mapInArrow(
            _scan_or_send(rules), f"blob binary, text string, {LEDGER.split(', ', 1)[1]}"
        ),
        "scans",
    )
    held = first.filter("text is not null").select("blob", "text").dropDuplicates(["blob"])
    needed = (
        held.join(special, "blob", "left")
        .withColumn("todo", F.coalesce("todo", wanted))
        .filter(F.size("todo") > 0)
        .select("blob", "text", "todo")
    )
    ledger.append(
        first.filter("text is null").select("blob", "rules", "findings").unionByName(
            needed.mapInArrow(_scan_needed(rules), LEDGER)
        )
    )

    found = staged(ledger.findings(rules), "findings")
    may_have = membership(found, "blob")("__blob")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    marked = paths.withColumn("__may", may_have)
    # stored sides, so that Spark can split the join of a blob that stands at very many paths
    met = marked.filter("__may").join(found.hint("shuffle_merge"), F.col("__blob") == F.col("blob"), "left")
    out = [*[F.col(f"`{c}`") for c in path_cols], F.lower(F.hex("__blob")).alias("blob")]
    return (
        marked.filter(~F.col("__may"))
        .select(*out, none.alias("findings"))
        .unionByName(met.select(*out, F.coalesce("findings", none).alias("findings")))
    )


def span_text(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    each = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return F.array_join(each, ",")
