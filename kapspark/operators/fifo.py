"""FIFO lot matching without row loops: running positions plus an as-of scan.

Per (account_id, isin), order the trades by (ts, buys first, tiebreak...).
The running sum of bought quantity gives every lot an interval
``(lot_end - lot_qty, lot_end]`` on a "quantity axis", the running sum of sold
quantity does the same for every sale. With enough inventory at each sale,
FIFO consumption is exactly the overlap of these intervals. Every overlap is
one elementary segment between two consecutive breakpoints (lot ends and sale
ends together), so one descending scan over the breakpoints finds, for each
segment, the lot and the sale that contain it (``last(..., ignorenulls)``
over the frame ``p >= current``) and its start (``lead``). No pairs are ever
enumerated: the number of segments is at most lots + sales.

Stage A (running sums, shortfall) and stage B (segment scan) use windows with
the same partition keys, and the per-sale aggregate groups by a superset of
them, so the whole operator costs one exchange.

Keys with more trade rows than ``cfg.fifo_hot_key_rows`` are matched by
``match_chunked`` instead: a range partitioning by key and trade order (all
order columns, so equal timestamps are split too) cuts them into chunks of
about ``cfg.fifo_chunk_rows`` rows, and the running sums / scans are carried
across chunks through small per-chunk summary tables, so no task holds a
whole hot key. Both ways give the same result for any key.

What is left of the lots (``open_lots``) is a state to go on from: a run over later
bookings takes it instead of all the history before. A lot goes on with its remaining
quantity and its original quantity and cost, so the costs of later sales are the same
to the last digit; a key that was short or invalid stays so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark.config import TaxConfig
from kapspark.functions import money_sum
from kapspark.sources.staging import stage

KEY = (C.ACCOUNT, C.ISIN)
BUY, SELL = 0, 1
# Orders bookings that no named column orders: a hash of their other columns.
TIE = "_tie"


def _tiebreak(cfg: TaxConfig) -> list[str]:
    return [c for c in cfg.tiebreak if c not in (C.TS, "side")]


def with_total_order(ledger_fx: DataFrame, cfg: TaxConfig) -> tuple[DataFrame, TaxConfig]:
    """The ledger and the configuration with the tiebreak columns spelled out.

    Without named columns bookings of one timestamp are ordered by
    ``order_no`` (where the ledger has it) and a hash of all other columns:
    the order of the input never decides. A named column must exist.
    """
    if cfg.tiebreak is not None:
        absent = [c for c in cfg.tiebreak if c not in ledger_fx.columns]
        if absent:
            raise ValueError(f"tiebreak columns are not in the ledger: {absent}")
        return ledger_fx, cfg
    named = ["order_no"] if "order_no" in ledger_fx.columns else []
    others = sorted(
        f.name
        for f in ledger_fx.schema
        if f.name not in (*KEY, C.TS, TIE, *named) and f.dataType.typeName() not in ("map", "variant")
    )
    return ledger_fx.withColumn(TIE, F.xxhash64(*others)), cfg.with_(tiebreak=(*named, TIE))


def booking_order(cfg: TaxConfig) -> list[Column]:
    """The total order of bookings that ``with_total_order`` spells out."""
    return [F.col(C.TS), *[F.col(c) for c in _tiebreak(cfg)]]


def trades_of(ledger_fx: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Buys and sells of all years (a type in both lists counts as a buy)."""
    side = (
        F.when(F.col(C.TYPE).isin(*cfg.purchase_types), F.lit(BUY))
        .when(F.col(C.TYPE).isin(*cfg.sale_types), F.lit(SELL))
    )
    extra = [c for c in _tiebreak(cfg) if c not in (C.QUANTITY,)]
    cols = [C.ACCOUNT, C.ISIN, C.TS, C.TAX_YEAR, C.QUANTITY, "net_eur"] + [c for c in extra if c != "net_eur"]
    return (
        ledger_fx.withColumn("side", side)
        .where(F.col("side").isNotNull())
        .select(*dict.fromkeys(cols), "side")
    )


def _with_lots(trades: DataFrame, lots: DataFrame | None, cfg: TaxConfig) -> DataFrame:
    """Trades after the open lots of an earlier run (see ``open_lots``), which come as buys."""
    if lots is None:
        return trades
    trades = trades.withColumns(
        {"lot_qty": F.col(C.QUANTITY), "was_short": F.lit(False), "was_bad": F.lit(False)}
    )
    absent = [c for c in _tiebreak(cfg) if c not in lots.columns and c not in (C.QUANTITY, "net_eur")]
    if absent:
        raise ValueError(f"tiebreak columns are not in the lots: {absent}")
    kinds = dict(trades.dtypes)
    known = {
        C.QUANTITY: F.col("remaining"),
        "net_eur": -F.col("lot_cost_eur"),
        "side": F.lit(BUY),
        "was_short": F.col("shortfall"),
        "was_bad": F.col("invalid"),
    }
    bought = lots.select(*[known.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in trades.columns])
    return trades.unionByName(bought)


# With the open lots of an earlier run trades have three columns more: ``lot_qty`` (the bought
# quantity; ``quantity`` is what of it is still there) and the key's flags of that run.


def _lot_qty(df: DataFrame) -> Column:
    return F.col("lot_qty" if "lot_qty" in df.columns else C.QUANTITY)


def _short(df: DataFrame) -> Column:
    return F.col("short_row") | F.col("was_short") if "was_short" in df.columns else F.col("short_row")


def _bad_row(df: DataFrame) -> Column:
    """Rows that make FIFO undefined for their key (the reference aborts)."""
    own = (
        F.col(C.ISIN).isNull()
        | F.col(C.QUANTITY).isNull()
        | (F.col(C.QUANTITY) <= 0)
        | F.col(C.TS).isNull()
        | F.col("net_eur").isNull()
    )
    if "was_bad" not in df.columns:
        return own
    # lots of a key that was flagged before have no remaining quantity; their flags say why
    return F.when(F.col("was_short") | F.col("was_bad"), F.col("was_bad")).otherwise(own)


def _signed(side: int) -> Column:
    return F.when(F.col("side") == side, F.col(C.QUANTITY)).otherwise(F.lit(0).cast(C.QUANTITY_TYPE))


def _order(cfg: TaxConfig) -> list[Column]:
    return [F.col(C.TS), F.col("side")] + [F.col(c) for c in _tiebreak(cfg)]


def _running(df: DataFrame, cfg: TaxConfig, part: list[str], with_offsets: bool) -> DataFrame:
    """Running bought / sold quantity in time order within ``part``; adds
    ``off_buy`` / ``off_sell`` when the partition is a chunk of a key."""
    w_run = Window.partitionBy(*part).orderBy(*_order(cfg)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum_buy = F.sum(_signed(BUY)).over(w_run)
    cum_sell = F.sum(_signed(SELL)).over(w_run)
    if with_offsets:
        cum_buy = F.col("off_buy") + cum_buy
        cum_sell = F.col("off_sell") + cum_sell
    df = df.withColumns({"cum_buy": cum_buy, "cum_sell": cum_sell})
    short = (F.col("side") == SELL) & (F.col("cum_sell") > F.col("cum_buy"))
    df = df.withColumn("short_row", F.coalesce(short, F.lit(False)))
    return df.withColumns(
        {
            "missing_qty": F.when(
                F.col("short_row"), F.least(F.col(C.QUANTITY), F.col("cum_sell") - F.col("cum_buy"))
            ),
            "bad_row": _bad_row(df),
        }
    )


def positions(trades: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Stage A: running bought / sold quantity, shortfall per sale, key flags."""
    w_key = Window.partitionBy(*KEY)
    df = _running(trades, cfg, list(KEY), with_offsets=False)
    return df.withColumns(
        {
            "key_short": F.max(_short(df)).over(w_key),
            "key_bad": F.max("bad_row").over(w_key),
        }
    )


def _breakpoints(pos: DataFrame, cfg: TaxConfig, extra: tuple[str, ...] = ()) -> DataFrame:
    """One breakpoint per trade: a lot end (buy) or a sale end (sell)."""
    p = F.when(F.col("side") == BUY, F.col("cum_buy")).otherwise(F.col("cum_sell"))
    lot = F.when(
        F.col("side") == BUY,
        F.struct(
            F.col("p").alias("lot_end"),
            _lot_qty(pos).alias("lot_qty"),
            (-F.col("net_eur")).alias("lot_cost"),
        ),
    )
    sale_fields = [
        F.col("p").alias("sale_end"),
        F.col(C.TS),
        F.col(C.TAX_YEAR),
        F.col(C.QUANTITY),
        F.col("net_eur").alias("proceeds_eur"),
        F.col("missing_qty"),
    ] + [F.col(c) for c in _tiebreak(cfg) if c not in (C.QUANTITY,)]
    sale = F.when(F.col("side") == SELL, F.struct(*sale_fields))
    return pos.withColumn("p", p).select(
        *KEY, "p", "side", lot.alias("lot"), sale.alias("sale"), "key_short", "key_bad", *extra
    )


def _piece(lot: Column, seg_len: Column, seg_start: Column, cost_mode: str) -> Column:
    """Cost of one segment of a lot.

    ``pro_rata``: the lot's cost per unit times the length. ``as_observed``
    divides by the lot's quantity still open when the segment starts, which
    reproduces the reference's stale-cost behaviour on partly used lots.
    """
    if cost_mode == "pro_rata":
        denom = lot["lot_qty"]
    else:
        denom = lot["lot_end"] - seg_start
    return lot["lot_cost"] * seg_len.cast("double") / denom.cast("double")


def _scan_local(bp: DataFrame, part: list[str]) -> DataFrame:
    """Stage B scan: for every breakpoint the lot and the sale containing the
    segment that ends there, and the segment's start (within ``part``)."""
    w = Window.partitionBy(*part).orderBy(F.col("p").desc(), F.col("side").asc())
    # by rows: a sale always meets itself, also where a bad quantity gives equal positions
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bp.withColumns(
        {
            "lot_here": F.last("lot", ignorenulls=True).over(seen),
            "sale_here": F.last("sale", ignorenulls=True).over(seen),
            "seg_start": F.lead("p", 1).over(w),
        }
    )


def _sale_fields(cfg: TaxConfig) -> list[str]:
    return [C.TS, C.TAX_YEAR, C.QUANTITY, "proceeds_eur", "missing_qty"] + [
        c for c in _tiebreak(cfg) if c not in (C.QUANTITY,)
    ]


def _segments(seg: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Segment rows -> (sale fields, piece of cost) for segments inside a sale."""
    seg = seg.withColumn("seg_start", F.coalesce(F.col("seg_start"), F.lit(0).cast(C.QUANTITY_TYPE)))
    seg_len = F.col("p") - F.col("seg_start")
    piece = F.when(
        F.col("lot_here").isNotNull() & (seg_len > 0),
        _piece(F.col("lot_here"), seg_len, F.col("seg_start"), cfg.cost_mode),
    )
    return seg.where(F.col("sale_here").isNotNull()).select(
        *KEY,
        F.col("sale_here.sale_end").alias("sale_end"),
        *[F.col(f"sale_here.{c}").alias(c) for c in _sale_fields(cfg)],
        piece.alias("piece"),
        "key_short",
        "key_bad",
    )


def _per_sale(segments: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Sum the pieces per sale. The sale's own fields depend only on
    (key, sale_end), so grouping by them keeps the groups and lets the
    aggregate stay a hash aggregate (no sort, no extra exchange)."""
    fields = _sale_fields(cfg)
    agg = segments.groupBy(*KEY, "sale_end", *fields).agg(
        money_sum(F.col("piece")).alias("_cost"),
        F.max("key_short").alias("shortfall"),
        F.max("key_bad").alias("invalid"),
    )
    flagged = F.col("shortfall") | F.col("invalid")
    cost = F.when(~flagged, F.col("_cost").cast("double"))
    extra = [c for c in _tiebreak(cfg) if c not in (C.QUANTITY,)]
    return agg.select(
        *KEY,
        C.TS,
        C.TAX_YEAR,
        C.QUANTITY,
        "proceeds_eur",
        cost.alias("cost_eur"),
        (F.col("proceeds_eur") - cost).alias("result_eur"),
        "shortfall",
        "missing_qty",
        "invalid",
        *extra,
    )


def match_simple(trades: DataFrame, cfg: TaxConfig) -> DataFrame:
    """All three stages on one hash partitioning by (account_id, isin)."""
    bp = _breakpoints(positions(trades, cfg), cfg)
    return _per_sale(_segments(_scan_local(bp, list(KEY)), cfg), cfg)


# --- skewed keys -----------------------------------------------------------
# Rows of hot keys are range-partitioned by key and order; a partition is a
# chunk, contiguous in the order being scanned. The chunk number is written
# with the rows, so everything derived from it agrees. What crosses a chunk
# border (running-sum offsets, the next lot / sale after a chunk, the last
# breakpoint before it, the flags of the key) travels through per-chunk
# summary tables, which are tiny next to the rows, and every join of rows is
# on key and chunk.


def hot_keys(source: DataFrame, cfg: TaxConfig) -> tuple[DataFrame, int] | None:
    """(account_id, isin) of keys with more than ``cfg.fifo_hot_key_rows``
    trades and the number of their trades, or None when there are none.

    ``source`` is the ledger (any frame with account_id, isin, type, ts):
    one aggregate with map-side partial counts, no FX join. The table has at
    most total rows / threshold rows; it stays distributed.
    """
    if cfg.fifo_hot_key_rows is None:
        return None
    is_trade = F.col(C.TYPE).isin(*cfg.purchase_types, *cfg.sale_types)
    counts = source.where(is_trade).groupBy(*KEY).count().where(F.col("count") > cfg.fifo_hot_key_rows)
    rows = counts.agg(F.sum("count")).first()[0]
    return (counts.select(*KEY), rows) if rows else None


def _chunked(df: DataFrame, order: list[Column], rows: int, cfg: TaxConfig, name: str) -> DataFrame:
    """Add ``name``: contiguous ranges of (key, order) with about
    ``cfg.fifo_chunk_rows`` rows each. Rows that are equal in every order
    column are interchangeable; a row number lets them be split as well."""
    parts = max(2, -(-rows // cfg.fifo_chunk_rows))
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *KEY, *order, "_row")
    return stage(ranged.withColumn(name, F.spark_partition_id().cast("long")).drop("_row"), name)


def _carry(df: DataFrame, summary: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Join a per-chunk summary back onto rows (null-safe keys)."""
    renamed = summary.select(
        *[F.col(c).alias(f"_s_{c}") for c in on], *[c for c in summary.columns if c not in on]
    )
    cond = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        cond = term if cond is None else cond & term
    return df.join(renamed, cond).drop(*[f"_s_{c}" for c in on])


def positions_chunked(trades: DataFrame, rows: int, cfg: TaxConfig) -> DataFrame:
    """Stage A for hot keys: running sums per time chunk plus the totals of
    the earlier chunks, and the key's flags."""
    on = KEY + ("tchunk",)
    t = _chunked(trades, _order(cfg), rows, cfg, "tchunk")
    earlier = Window.partitionBy(*KEY).orderBy("tchunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(C.QUANTITY_TYPE)
    totals = t.groupBy(*on).agg(F.sum(_signed(BUY)).alias("tot_buy"), F.sum(_signed(SELL)).alias("tot_sell"))
    offsets = totals.select(
        *on,
        F.coalesce(F.sum("tot_buy").over(earlier), zero).alias("off_buy"),
        F.coalesce(F.sum("tot_sell").over(earlier), zero).alias("off_sell"),
    )
    pos = _running(_carry(t, offsets, on), cfg, list(on), with_offsets=True)
    of_key = Window.partitionBy(*KEY)
    flags = (
        pos.groupBy(*on)
        .agg(F.max(_short(pos)).alias("s"), F.max("bad_row").alias("b"))
        .select(*on, F.max("s").over(of_key).alias("key_short"), F.max("b").over(of_key).alias("key_bad"))
    )
    return _carry(pos, flags, on)


def match_chunked(trades: DataFrame, rows: int, cfg: TaxConfig) -> DataFrame:
    """FIFO for hot keys without ever holding a whole key in one task."""
    on = KEY + ("pchunk",)
    pos = positions_chunked(trades, rows, cfg)
    # Stage B: breakpoints in position order (lot ends above sale ends), chunked by position
    bp = pos.withColumn("p", F.when(F.col("side") == BUY, F.col("cum_buy")).otherwise(F.col("cum_sell")))
    bp = _chunked(bp, [F.col("p"), F.col("side").desc()], rows, cfg, "pchunk")
    bp = _breakpoints(bp, cfg, extra=("pchunk",))
    scan = _scan_local(bp, list(on))
    summary = bp.groupBy(*on).agg(
        F.min(F.when(F.col("side") == BUY, F.struct(F.col("p").alias("k"), F.col("lot").alias("v")))).alias("fl"),
        F.min(F.when(F.col("side") == SELL, F.struct(F.col("p").alias("k"), F.col("sale").alias("v")))).alias("fs"),
        F.max("p").alias("max_p"),
    )
    onward = Window.partitionBy(*KEY).orderBy("pchunk").rowsBetween(1, Window.unboundedFollowing)
    previous = Window.partitionBy(*KEY).orderBy("pchunk")
    border = summary.select(
        *on,
        F.first(F.col("fl.v"), ignorenulls=True).over(onward).alias("next_lot"),
        F.first(F.col("fs.v"), ignorenulls=True).over(onward).alias("next_sale"),
        F.lag("max_p", 1).over(previous).alias("prev_p"),
    )
    scan = _carry(scan, border, on).withColumns(
        {
            "lot_here": F.coalesce(F.col("lot_here"), F.col("next_lot")),
            "sale_here": F.coalesce(F.col("sale_here"), F.col("next_sale")),
            "seg_start": F.coalesce(F.col("seg_start"), F.col("prev_p")),
        }
    )
    return _per_sale(_segments(scan, cfg), cfg)


def _split(trades: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades of the other keys and of the hot keys."""
    hot = keys.select(*[F.col(c).alias(f"_h_{c}") for c in KEY])
    cond = F.col(C.ACCOUNT).eqNullSafe(F.col(f"_h_{C.ACCOUNT}")) & F.col(C.ISIN).eqNullSafe(F.col(f"_h_{C.ISIN}"))
    return trades.join(hot, cond, "left_anti"), trades.join(hot, cond, "left_semi")


def _ordered_trades(
    ledger_fx: DataFrame, cfg: TaxConfig, ledger: DataFrame | None, lots: DataFrame | None
) -> tuple[DataFrame, TaxConfig, tuple[DataFrame, int] | None]:
    """Trades with the open lots of an earlier run, the spelled-out order, and the hot keys."""
    ordered, cfg = with_total_order(ledger_fx, cfg)
    trades = _with_lots(trades_of(ordered, cfg), lots, cfg)
    source = ledger if ledger is not None else ledger_fx
    if lots is not None and cfg.fifo_hot_key_rows is not None:
        # a lot weighs like a buy
        buy = F.lit(cfg.purchase_types[0])
        source = source.select(*KEY, C.TYPE).unionByName(lots.select(*KEY, buy.alias(C.TYPE)))
    return trades, cfg, hot_keys(source, cfg)


def realized_sales(
    ledger_fx: DataFrame, cfg: TaxConfig, ledger: DataFrame | None = None, lots: DataFrame | None = None
) -> DataFrame:
    """One row per sale (all years) with FIFO cost, result and flags.

    Sales of a key with a shortfall or an invalid trade keep ``cost_eur`` and
    ``result_eur`` NULL (``shortfall`` / ``invalid`` set) and stay out of
    every total. Hot keys are found on ``ledger`` (the frame before FX) when
    given, else on ``ledger_fx``; they need ``spark.checkpoint.dir``.
    ``lots``: the ``open_lots`` of an earlier run; ``ledger_fx`` then has only
    the bookings after it.
    """
    trades, cfg, found = _ordered_trades(ledger_fx, cfg, ledger, lots)
    if found is None:
        return match_simple(trades, cfg).drop(TIE)
    keys, rows = found
    normal, skewed = _split(trades, keys)
    return match_simple(normal, cfg).unionByName(match_chunked(skewed, rows, cfg)).drop(TIE)


def _lots_of(pos: DataFrame, cfg: TaxConfig, sold: Column) -> DataFrame:
    """Open lots from positions (stage A); ``sold``: the key's whole sold quantity."""
    flagged = F.col("key_short") | F.col("key_bad")
    zero = F.lit(0).cast(C.QUANTITY_TYPE)
    left = F.greatest(zero, F.least(F.col(C.QUANTITY), F.col("cum_buy") - sold)).cast(C.QUANTITY_TYPE)
    cost = -F.col("net_eur")
    # a partly used lot: its cost per unit goes on, or (as observed) its whole cost
    share = F.col("remaining").cast("double") / _lot_qty(pos).cast("double")
    open_cost = cost * share if cfg.cost_mode == "pro_rata" else cost
    extra = [c for c in _tiebreak(cfg) if c not in (C.QUANTITY, "net_eur", C.TAX_YEAR)]
    lots = pos.where(F.col("side") == BUY).withColumn("remaining", F.when(~flagged, left))
    return lots.where(flagged | (F.col("remaining") > 0)).select(
        *KEY,
        C.TS,
        C.TAX_YEAR,
        _lot_qty(pos).alias("lot_qty"),
        "remaining",
        cost.alias("lot_cost_eur"),
        F.when(~flagged, open_cost).alias("open_cost_eur"),
        F.col("key_short").alias("shortfall"),
        F.col("key_bad").alias("invalid"),
        *extra,
    )


def open_lots(
    ledger_fx: DataFrame, cfg: TaxConfig, ledger: DataFrame | None = None, lots: DataFrame | None = None
) -> DataFrame:
    """What all sales leave of each lot: ``lot_qty`` bought, ``remaining`` and its ``open_cost_eur``.

    Used-up lots have no row. Of a key with a shortfall or an invalid trade every lot has a row
    with its flag and without a remaining quantity. ``lots`` as in ``realized_sales``. The same
    exchange serves running sums and the key's whole sold quantity.
    """
    trades, cfg, found = _ordered_trades(ledger_fx, cfg, ledger, lots)

    def simple_lots(part: DataFrame) -> DataFrame:
        whole = positions(part, cfg).withColumn("_sold", F.sum(_signed(SELL)).over(Window.partitionBy(*KEY)))
        return _lots_of(whole, cfg, F.col("_sold"))

    if found is None:
        return simple_lots(trades)
    keys, rows = found
    normal, skewed = _split(trades, keys)
    pos = positions_chunked(skewed, rows, cfg)
    sold = pos.groupBy(*KEY).agg(F.sum(_signed(SELL)).alias("_sold"))
    return simple_lots(normal).unionByName(_lots_of(_carry(pos, sold, KEY), cfg, F.col("_sold")))


def trade_positions(ledger_fx: DataFrame, cfg: TaxConfig, ledger: DataFrame | None = None) -> DataFrame:
    """Stage A for every trade (running sums, shortfall, key flags), with
    hot keys computed chunk by chunk like ``realized_sales``."""
    ordered, cfg = with_total_order(ledger_fx, cfg)
    trades = trades_of(ordered, cfg)
    cols = trades.columns + ["cum_buy", "cum_sell", "short_row", "missing_qty", "bad_row", "key_short", "key_bad"]
    found = hot_keys(ledger if ledger is not None else ledger_fx, cfg)
    if found is None:
        return positions(trades, cfg).select(*cols)
    keys, rows = found
    normal, skewed = _split(trades, keys)
    return positions(normal, cfg).select(*cols).unionByName(positions_chunked(skewed, rows, cfg).select(*cols))
