"""The blob ledger against a plain scan of every text."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from kapspark.llm import queries, secret_ledger
from kapspark.llm.secret_ledger import ADDED, BASE, BlobLedger, Rule, scan

AKIA = "AKIA" + "Q7" * 8
HEX = "0123456789abcdef" * 2
GITHUB = "ghp_" + "aB3" * 12
CASES = [
    f"password = '{HEX}' and {AKIA}.",
    "PassWd:hunter22 token=short tOkEn = longenough",
    "secret=password=hunter2, api-key=abcdefg, api_key : abcdefg, APIKEY=abcdefg",
    "ſecret=abcdefg toKen=abcdefg",  # letters beyond ASCII are not s and k
    "token   \n=abcdef",
    f"xAKIA{'A' * 15} {AKIA}{AKIA}",
    "g" + HEX[:23] + " " + HEX[:24] + "g" + HEX,
    f"é𝄞 {GITHUB} -----BEGIN RSA PRIVATE KEY-----",
    "",
    None,
]


def plain_spans(text):
    """Straight from the contract: leftmost matches of the plain patterns, failing ones dropped."""
    text, out = text or "", []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for place, (kind, pattern, group, least) in enumerate(
        [
            ("assign", assign, 2, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20),
            ("hex", "[0-9a-f]+", 0, 24),
            ("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
            ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ]
    ):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                out.append((m.start(), place, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def listed(rows):
    return sorted(((r["doc_id"], r["blob"], tuple((f.kind, f.start, f.end) for f in r["findings"])) for r in rows), key=repr)


def wanted(rows):
    return sorted(
        ((i, hashlib.sha256((t or "").encode()).hexdigest(), tuple(plain_spans(t))) for i, t in rows), key=repr
    )


def scanned(ledger):
    """Every (blob, rule version) pair of the ledger's rows."""
    rows = ledger.rows().select(F.hex("blob").alias("b"), F.explode("rules").alias("r")).collect()
    return [(r["b"], r["r"]) for r in rows]


def test_findings_against_a_plain_scan(spark, docs_of):
    rows = list(enumerate(CASES)) + [(50, CASES[0]), (50, CASES[0]), (None, CASES[1]), (51, "x" * 300_000 + AKIA)]
    out = scan(docs_of(rows, extra=True), BlobLedger(spark)).collect()
    assert listed(out) == wanted(rows)


def test_random_texts(spark, docs_of):
    rnd = random.Random(11)
    bits = ["password", "Token", "api_key", "=", ":", " ", "'", '"', "AKIA", "ABCD1234" * 2, HEX, "abc", "Z", "é", "\n", "hunter22"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)]
    assert listed(scan(docs_of(rows), BlobLedger(spark)).collect()) == wanted(rows)


def test_only_unseen_pairs_are_scanned(spark, docs_of):
    ledger = BlobLedger(spark)
    first = [(i, f"text {i} {AKIA}") for i in range(20)] + [(90, "text 0 " + AKIA)]
    scan(docs_of(first), ledger, BASE).collect()
    assert len(scanned(ledger)) == len(set(scanned(ledger))) == 20 * len(BASE)
    # the same versions again: nothing to do; a new version and a copy of an old one: one blob
    later = first + [(3, "text 3, changed"), (4, "text 5 " + AKIA)]
    out = scan(docs_of(later), ledger, BASE).collect()
    assert listed(out) == wanted(later)
    assert len(scanned(ledger)) == len(set(scanned(ledger))) == 21 * len(BASE)
    # one more rule: each blob meets only that rule
    scan(docs_of(later), ledger, BASE + ADDED[:1]).collect()
    assert len(scanned(ledger)) == len(set(scanned(ledger))) == 21 * (len(BASE) + 1)
    # a changed rule is another version, and the findings of the old one are not shown
    stricter = (*BASE[:1], Rule("access", r"AKIA[A-Z0-9]+", least=99), *BASE[2:])
    out = scan(docs_of(later), ledger, stricter).collect()
    assert all(not r["findings"] for r in out)
    assert len(scanned(ledger)) == len(set(scanned(ledger))) == 21 * (len(BASE) + 2)


def test_findings_come_from_the_ledger(spark, docs_of):
    """What an earlier run stored is joined to new paths without another scan."""
    ledger = BlobLedger(spark)
    scan(docs_of([(1, AKIA)]), ledger).collect()
    planted = ledger.rows().withColumn("findings", F.expr("transform(findings, f -> struct(f.rule, 7 as start, 9 as end))"))
    other = BlobLedger(spark)
    other.append(planted)
    out = scan(docs_of([(2, AKIA), (3, AKIA)]), other).collect()
    assert [(f.kind, f.start, f.end) for r in out for f in r["findings"]] == [("access", 7, 9)] * 2


def test_a_row_that_was_appended_twice_counts_once(spark, docs_of):
    ledger = BlobLedger(spark)
    rows = [(1, AKIA), (2, "clean")]
    scan(docs_of(rows), ledger).collect()
    ledger.append(spark.createDataFrame(ledger.rows().collect(), ledger.rows().schema))
    assert listed(scan(docs_of(rows), ledger).collect()) == wanted(rows)


def test_full_filters_change_nothing(spark, docs_of, monkeypatch):
    """With filters that say yes to everything, all texts take the exact way."""
    monkeypatch.setattr(secret_ledger, "membership", lambda keys, *c: lambda *v: F.lit(True))
    rows = list(enumerate(CASES)) + [(i, CASES[i % 5]) for i in range(20, 60)]
    ledger = BlobLedger(spark)
    assert listed(scan(docs_of(rows), ledger).collect()) == wanted(rows)
    assert listed(scan(docs_of(rows), ledger).collect()) == wanted(rows)
    assert ledger.rows().count() == len({t or "" for _, t in rows})


def test_an_empty_table(spark, docs_of):
    ledger = BlobLedger(spark)
    assert scan(docs_of([(1, "a")]).filter("doc_id < 0"), ledger).collect() == []
    assert ledger.rows().count() == 0


def test_the_query(spark, docs_of, tmp_path):
    rows = list(enumerate(CASES))
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op11_secret_ledger(spark, str(tmp_path)).collect()}
    for i, t in rows:
        all_spans = plain_spans(t)
        base = [s for s in all_spans if s[0] in ("assign", "access", "hex")]
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert out[i]["spans"] == text(all_spans)
        assert out[i]["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [
            sum(s[0] == k for s in base) for k in ("assign", "access", "hex")
        ]
