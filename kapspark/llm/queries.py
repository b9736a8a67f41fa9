"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, filter_audit, html_extract, mixing, pii, secret_ledger, sharding, simhash, toxicity, turn_repair, warc
from .shared import UPPER, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = 40
QUERY_EVERY = 50
# The key of a deployment comes from its secret store; this one only makes results repeatable.
PII_KEY = b"key of the registered query"

# Production mixture: domains by source, weights of domains, languages and sources.
MIX = mixing.Mix(
    domain_of={
        f"src{k}": domain
        for domain, numbers in {"web": range(8), "forum": range(8, 12), "books": range(12, 16), "news": range(16, 20)}.items()
        for k in numbers
    },
    domains={"web": 4, "forum": 1, "books": 3, "news": 2},
    langs={"en": 5, "de": 2, "fr": 2, "es": 1},
    sources={"src0": 3},
    share=0.6,
    epochs=2,
    seed="mix-1",
)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_EVERY == 0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), keep_cols=["page_id", "url"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, keep_cols=["doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX, keep_cols=["doc_id", "lang", "source"])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan(table(spark, sf_dir, "documents"), secret_ledger.BlobLedger(spark))
    findings = F.col("findings")

    def of(kind: str) -> Column:
        return F.filter(findings, lambda f: f["kind"] == kind)

    base = F.filter(findings, lambda f: f["kind"].isin([r.kind for r in secret_ledger.BASE]))
    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secret_ledger.BASE],
        F.sha2(secret_ledger.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_ledger.span_text(findings).alias("spans"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_html_extraction": op2_html_extraction,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
    "op11_secret_ledger": op11_secret_ledger,
    "op12_filter_audit": op12_filter_audit,
    "op13_turn_repair": op13_turn_repair,
}


def _fill_sql(name: str, parent: list[str], level: str, weights: dict[str, int]) -> str:
    """One level of the budget tree: full children first, the rest by weight."""
    keys = ", ".join(parent)
    weight = "".join(f" WHEN '{k}' THEN {w}" for k, w in sorted(weights.items()))
    weight = f"CAST(CASE {level}{weight} ELSE 1 END AS DOUBLE)" if weight else "CAST(1 AS DOUBLE)"
    nodes = ", ".join([*parent, level])
    return f"""
{name}_n AS (SELECT {nodes}, CAST(sum(capacity) AS DOUBLE) AS capacity FROM leaves GROUP BY {nodes}),
{name}_w AS (
  SELECT n.*, p.budget AS given, {weight} AS w, CASE WHEN {weight} > 0 THEN capacity / {weight} ELSE 'inf'::DOUBLE END AS need
  FROM {name}_n n JOIN {{up}} p USING ({keys})),
{name}_r AS (
  SELECT *, (given - coalesce(sum(CASE WHEN w > 0 THEN capacity END) OVER
      (PARTITION BY {keys} ORDER BY need, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(w) OVER (PARTITION BY {keys} ORDER BY need, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate
  FROM {name}_w),
{name}_f AS (SELECT *, w > 0 AND rate * w >= capacity AS is_full FROM {name}_r),
{name} AS (
  SELECT {nodes}, CASE WHEN is_full THEN capacity WHEN w > 0 THEN
      (given - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {keys}), 0)) * w
      / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {keys})
    ELSE 0 END AS budget
  FROM {name}_f)"""


def mixing_sql(mix: mixing.Mix) -> str:
    domains = "".join(f" WHEN '{k}' THEN '{v}'" for k, v in sorted(mix.domain_of.items()))
    levels = [("d", ["root"], "domain", mix.domains), ("l", ["root", "domain"], "lang", mix.langs)]
    levels.append(("s", ["root", "domain", "lang"], "source", mix.sources))
    steps, up = [], "total"
    for name, parent, level, weights in levels:
        steps.append(_fill_sql(name, parent, level, dict(weights)).replace("{up}", up))
        up = name
    filled = ",".join(steps)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang_l, coalesce(source, 'unknown') AS source_l, lang AS lang_c, source AS source_c,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents),
leaves AS (
  SELECT 0 AS root, CASE source_l{domains} ELSE 'unknown' END AS domain, lang_l AS lang, source_l AS source,
    CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) * {mix.epochs} AS capacity
  FROM docs GROUP BY ALL),
total AS (SELECT root, floor(CAST(sum(tokens) AS DOUBLE) * CAST({mix.share} AS DOUBLE)) AS budget FROM leaves GROUP BY root),
{filled},
plan AS (
  SELECT lang, source, tokens, CAST(floor(budget) AS BIGINT) AS b,
    CASE WHEN tokens > 0 THEN CAST(floor(budget) AS BIGINT) // tokens ELSE 0 END AS whole,
    CASE WHEN tokens > 0 THEN CAST(floor(budget) AS BIGINT) % tokens ELSE 0 END AS rest
  FROM leaves JOIN s USING (root, domain, lang, source)),
keyed AS (
  SELECT d.*, p.whole, p.rest, md5('{mix.seed}:' || p.whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM docs d JOIN plan p ON d.lang_l = p.lang AND d.source_l = p.source),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY lang_l, source_l ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed),
taken AS (
  SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, lang_c AS lang, source_c AS source, CAST(unnest(range(CAST(times AS BIGINT))) AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens
FROM taken WHERE times > 0
"""


def secrets_sql(rules: tuple[secret_ledger.Rule, ...], base: tuple[secret_ledger.Rule, ...]) -> str:
    """Positions from the lengths of what stands before each match (lazily) and of the matches."""
    kinds = []
    for place, r in enumerate(rules):
        pattern = f"(?s)(.*?)({r.pattern})".replace("'", "''")
        value = 2 + r.group
        kinds.append(
            f"""SELECT doc_id, n, {place} AS place, '{r.kind}' AS kind, unnest(range(1, len(w) + 1)) AS i,
    unnest(regexp_extract_all(t, '{pattern}', 1)) AS before, unnest(w) AS whole, unnest(regexp_extract_all(t, '{pattern}', {value})) AS value,
    {r.least} AS least FROM (SELECT *, regexp_extract_all(t, '{pattern}', 2) AS w FROM d)"""
        )
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in base)
    listed = ", ".join(f"'{r.kind}'" for r in base)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
p AS (
  SELECT *, sum(length(before) + length(whole)) OVER (PARTITION BY n, place ORDER BY i) AS stop FROM m),
f AS (
  SELECT n, place, kind, stop - length(whole) AS start, kind || ':' || (stop - length(whole)) || ':' || stop AS span
  FROM p WHERE length(value) >= least)
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (WHERE kind IN ({listed})), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM d LEFT JOIN f USING (n) GROUP BY d.n, d.doc_id
"""


FILTER_AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 200,
     100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
     regexp_matches(t, '[#$%&*|]'),
     coalesce(doc_id > first_id, false)] AS fails
  FROM w JOIN x USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY ALL),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
o AS (
  SELECT [a.f, b.f, c.f, e.f, h.f] AS ord FROM k a, k b, k c, k e, k h
  WHERE len(list_distinct([a.f, b.f, c.f, e.f, h.f])) = 5),
s AS (
  SELECT part, ord, step, ord[step] AS own,
    sum(n) FILTER (WHERE NOT early AND NOT fails[ord[step]]) AS kept,
    sum(n) FILTER (WHERE NOT early AND fails[ord[step]]) AS removed,
    sum(n) FILTER (WHERE early AND fails[ord[step]]) AS redundant,
    sum(n) FILTER (WHERE fails[ord[step]] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails,
    sum(good) FILTER (WHERE NOT early AND fails[ord[step]]) AS good_lost,
    sum(toxic) FILTER (WHERE NOT early AND fails[ord[step]]) AS toxic_lost
  FROM (
    SELECT g.*, ord, step, len(list_filter(ord[1:step - 1], lambda y: fails[y])) > 0 AS early
    FROM g, o, (SELECT f AS step FROM k))
  GROUP BY part, ord, step)
SELECT part, array_to_string(list_transform(ord, lambda y: chr(64 + y)), '') AS filter_order, step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM s
"""

# Without insertions (they cost more than two deletions) all audits of a conversation's first rows are
# equally long, so texts of a fixed-width cost and the audit so far compare like (cost, audit).
_PUT = "CASE WHEN {v} IS NULL THEN NULL ELSE lpad(CAST(CAST(left({v}, 12) AS BIGINT) + {c} AS VARCHAR), 12, '0') || substr({v}, 13) || '{x}' END"


def _edit(state: str, cost: str, letter: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {_PUT.format(v=state, c=cost, x=letter)} END"


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda y: y IS NOT NULL))"


def turn_repair_sql() -> str:
    crc = (
        "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, CAST(length({k}) AS BIGINT) + 1), "
        "lambda i: [CAST(ord(substr({k}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    ).format(k="key")
    extra = "(CASE WHEN cut THEN 5 ELSE 0 END)"
    rerole = "(CASE WHEN cut THEN 6 ELSE 1 END)"

    def written(need: str, *states: str) -> list[str]:
        kept = [_edit(v, extra, "K", f"NOT gone AND ini = '{need}'") for v in states]
        return kept + [_edit(v, rerole, "R", "NOT gone") for v in states]

    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv, left(role, 1) AS ini,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS pos
  FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS two
  FROM placed),
r AS (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND open_end AS cut,
    two IS NOT NULL AND two NOT IN ('su', 'ua', 'au') AS bad FROM judged),
walk AS (
  SELECT conv, CAST(0 AS BIGINT) AS pos, '000000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2,
    CAST(NULL AS VARCHAR) AS v3 FROM (SELECT DISTINCT conv FROM r)
  UNION ALL
  SELECT walk.conv, r.pos,
    {_edit("v0", "2", "D")},
    {_least(_edit("v1", "2", "D"), _edit("v0", extra, "K", "NOT gone AND ini = 's'"))},
    {_least(_edit("v2", "2", "D"), *written("u", "v0", "v1", "v3"))},
    {_least(_edit("v3", "2", "D"), *written("a", "v2"))}
  FROM walk JOIN r ON r.conv = walk.conv AND r.pos = walk.pos + 1),
best AS (
  SELECT conv, CAST(left(v, 12) AS BIGINT) AS cost, substr(v, 13) AS audit
  FROM (SELECT conv, CASE WHEN v3 IS NULL THEN v0 ELSE least(v0, v3) END AS v
        FROM walk QUALIFY row_number() OVER (PARTITION BY conv ORDER BY pos DESC) = 1)),
edits AS (
  SELECT r.*, substr(audit, pos, 1) AS letter,
    sum(CASE WHEN substr(audit, pos, 1) = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv ORDER BY pos) AS nth,
    sum(CASE WHEN substr(audit, pos, 1) = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv) AS total
  FROM r JOIN best USING (conv)),
text_of AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (total - nth) % 2 = 0 THEN 'assistant' ELSE 'user' END
      || ':' || text, chr(10) ORDER BY pos) AS repaired
  FROM edits WHERE letter <> 'D' GROUP BY conv),
figures AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE bad) AS illegal
  FROM r GROUP BY conv)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv FROM conversations) c
LEFT JOIN figures USING (conv) LEFT JOIN best USING (conv) LEFT JOIN text_of USING (conv)
"""


ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op6_warc": f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES}
    THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
    "op8_mixing": mixing_sql(MIX),
    "op11_secret_ledger": secrets_sql(secret_ledger.BASE + secret_ledger.ADDED, secret_ledger.BASE),
    "op12_filter_audit": FILTER_AUDIT_SQL,
    "op13_turn_repair": turn_repair_sql(),
}
