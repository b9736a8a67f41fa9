"""Mixing sources to target weights by hierarchical budgeting.

A tree domain - language - source carries weights. A node hands its token budget to
its children in proportion to their weights; a child that holds fewer tokens than
its share (all its epochs counted) is filled up, and what it lacks goes to its
siblings, again by weight. As the amount a subtree can take is known before its
parent divides, a shortage leaves a subtree only when all siblings in it are full:
siblings come before ancestors. Each leaf then takes a prefix of seeded epochs: an
epoch is the leaf's documents in the order of a keyed hash; whole epochs first, of
the last one the longest prefix of whole documents within the budget.

Filling children is a closed form over siblings sorted by tokens per weight, so the
budget is a few windows over the table of leaves (one row for each source and
language). The prefix needs no global sort: documents fall into 4,096 ranges of
the hash, range totals find the one range in which the budget ends, and only that
range of each leaf is put in order. A leaf with a third of all rows is spread over
all ranges.

Only DataFrame functions are used.

Defined cases: a null or unknown label counts as the label ``unknown``; weights that
are not given are 1, and a weight of 0 takes nothing; null or empty texts have no
tokens and are taken with whole epochs and by their place in the last one;
rows that repeat an id are taken or left together; an empty table gives an empty
result; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

MAX_BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Targets of a mixture. `share`: budget as a share of all tokens of the input."""

    domain_of: Mapping[str, str] = field(default_factory=dict)
    domains: Mapping[str, int] = field(default_factory=dict)
    langs: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    share: float = 0.5
    epochs: int = 2
    seed: str = "mix-1"

    def weights(self, level: str) -> Mapping[str, int]:
        return {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]


def token_count(text: Column) -> Column:
    """White-space separated words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _pick(mapping: Mapping[str, object], key: Column, default) -> Column:
    if not mapping:
        return F.lit(default)
    entries = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(entries[key], F.lit(default))


def labelled(df: DataFrame, mix: Mix, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`df` with the labels of the tree as struct `leaf`."""
    lang = F.coalesce(F.col(lang_col), F.lit("unknown"))
    source = F.coalesce(F.col(source_col), F.lit("unknown"))
    domain = _pick(mix.domain_of, source, "unknown")
    return df.withColumn("__leaf", F.struct(domain.alias("domain"), lang.alias("lang"), source.alias("source")))


def fill(children: DataFrame, parent: list[str], level: str, weights: Mapping[str, int]) -> DataFrame:
    """Divide column `budget` of the parent among its children up to their `capacity`.

    Sorted by capacity per weight, the first children are full and the others share
    the rest by weight; a child is full when the rate of the rest, taken just before
    it, would give it its capacity or more.
    """
    siblings = Window.partitionBy(*parent)
    weighted = children.withColumn("w", _pick(weights, F.col(level), 1).cast("double")).withColumn(
        "need", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(float("inf")))
    )
    order = siblings.orderBy("need", level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("capacity"))).over(before), F.lit(0))
    rate = F.try_divide(F.col("budget") - earlier, F.sum("w").over(onward))
    full = (F.col("w") > 0) & (rate * F.col("w") >= F.col("capacity"))
    marked = weighted.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0))
    open_w = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(siblings)
    given = (
        F.when(F.col("full"), F.col("capacity").cast("double"))
        .when(F.col("w") > 0, left * F.col("w") / open_w)
        .otherwise(F.lit(0.0))
    )
    return marked.withColumn("budget", given).drop("w", "need", "full")


def leaf_budgets(leaf_tokens: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens, budget from leaf totals (domain, lang, source, tokens)."""
    leaves = leaf_tokens.withColumn("root", F.lit(0)).withColumn("capacity", F.col("tokens") * F.lit(mix.epochs))
    total = F.sum("tokens").over(Window.partitionBy("root"))
    budgets, parent = None, ["root"]
    for level in LEVELS:
        keys = [*parent, level]
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if budgets is None:  # the root's budget, divided among its children
            nodes = nodes.withColumn("budget", F.floor(total * F.lit(float(mix.share))).cast("double"))
        else:
            nodes = nodes.join(budgets, parent)
        budgets = fill(nodes, parent, level, mix.weights(level)).select(*keys, "budget")
        parent = keys
    return leaves.join(budgets, parent).select(*LEVELS, "tokens", F.floor("budget").cast("long").alias("budget"))


def order_key(mix: Mix, epoch: Column, key: Column) -> Column:
    name = F.coalesce(key.cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch.cast("string"), name))


def mix_sources(
    df: DataFrame,
    mix: Mix,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    keep_cols: list[str] | None = None,
) -> DataFrame:
    """The selected rows: `keep_cols` (default: all), `epoch` (from 0) and `n_tokens`.

    A row stands there once for each epoch that takes it.
    """
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c not in ("epoch", "n_tokens")]
    helper = [c for c in dict.fromkeys([id_col, text_col, lang_col, source_col]) if c not in keep]
    rows = labelled(df.select(*keep, *helper), mix, lang_col, source_col).withColumn(
        "__n", token_count(F.col(text_col))
    )
    facts = staged(rows.select("__leaf", F.col(id_col).alias("id"), "__n"), "mix-facts")
    leaf_tokens = facts.groupBy("__leaf").agg(F.sum("__n").alias("tokens")).select("__leaf.*", "tokens")
    plan = leaf_budgets(staged(leaf_tokens, "mix-leaves"), mix)
    # whole epochs, and the tokens wanted of the one that follows
    has_tokens = F.col("tokens") > 0
    plan = staged(
        plan.select(
            F.struct(*LEVELS).alias("__leaf"),
            F.when(has_tokens, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int").alias("__whole"),
            F.when(has_tokens, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).alias("__rest"),
        ),
        "mix-plan",
    )
    # a checked size: beyond it Spark joins by shuffle and splits the hot leaves
    small = F.broadcast if plan.count() <= MAX_BROADCAST_LEAVES else (lambda t: t)
    cutoffs = staged(_cutoffs(facts.join(small(plan.filter("__rest > 0")), "__leaf"), mix), "mix-cutoffs")
    chosen = (
        rows.join(small(plan.join(cutoffs, "__leaf", "left")), "__leaf")
        .withColumn("__key", order_key(mix, F.col("__whole"), F.col(id_col)))
        .withColumn("__more", F.coalesce((F.col("__key") <= F.col("__last")).cast("int"), F.lit(0)))
        .withColumn("__times", F.col("__whole") + F.col("__more"))
    )
    return chosen.filter("__times > 0").select(
        *keep,
        F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch"),
        F.col("__n").alias("n_tokens"),
    )


def _cutoffs(facts: DataFrame, mix: Mix) -> DataFrame:
    """(__leaf, __last): the largest key of the prefix; rows with one id stand together."""
    keyed = facts.withColumn("key", order_key(mix, F.col("__whole"), F.col("id"))).withColumn(
        "range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    )
    totals = keyed.groupBy("__leaf", "range").agg(
        F.sum("__n").alias("t"), F.max("key").alias("last"), F.first("__rest").alias("rest")
    )
    earlier = Window.partitionBy("__leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
    # ranges that fit whole, and the one in which the budget ends
    whole = ranges.filter("before + t <= rest").select("__leaf", "last")
    split = ranges.filter("before <= rest AND before + t > rest").select("__leaf", "range", "before", "rest")
    upto = Window.partitionBy("__leaf", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        keyed.join(split, ["__leaf", "range"])
        .groupBy("__leaf", "range", "key")
        .agg(F.sum("__n").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        .withColumn("sum", F.sum("n").over(upto))
        .filter("before + sum <= rest")
        .select("__leaf", F.col("key").alias("last"))
    )
    return whole.unionByName(inside).groupBy("__leaf").agg(F.max("last").alias("__last"))
