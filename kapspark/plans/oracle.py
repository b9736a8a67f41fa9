"""DuckDB SQL for every catalog query, written independently of the Spark code.

The SQL derives the same ledger from ``lineitem`` and ``part`` and the same
dimensions by formula, then computes each figure with plain SQL. FIFO uses a
different method on purpose: an interval-overlap join between lots and sales
on their cumulative quantity ranges (quadratic per key, fine for a check).
"""

from __future__ import annotations

_ISIN_PREFIXES = "['DE','CH','US','FR','IE','GB','LU','XS','12','JP']"
_TYPES = (
    "['Kauf','Kauf','Kauf','Kauf','Verkauf','Verkauf','Dividende','Dividende',"
    "'Zinsen auf Einlagen','Quellensteuer']"
)

_HEAD = f"""
WITH
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_shipdate,
         (l_orderkey + 3 * l_linenumber + l_suppkey) % 10 AS code,
         l_partkey % 400 AS sec_no
  FROM lineitem
),
ledger AS (
  SELECT CAST(floor(l_partkey / 8) AS BIGINT) AS account_id,
         CAST(l_shipdate + INTERVAL 24 YEAR AS TIMESTAMP) AS ts,
         ({_TYPES})[code + 1] AS type,
         ({_ISIN_PREFIXES})[sec_no % 10 + 1] || lpad(CAST(sec_no AS VARCHAR), 10, '0') AS isin,
         'Security ' || CAST(sec_no AS VARCHAR) AS name,
         (['EUR','USD','CHF'])[l_suppkey % 3 + 1] AS currency,
         CAST(l_quantity AS DECIMAL(20,8)) AS quantity,
         CASE WHEN code <= 3 THEN -l_extendedprice
              WHEN code <= 5 THEN l_extendedprice
              WHEN code = 9 THEN -(l_extendedprice / CAST(100 AS DOUBLE))
              ELSE l_extendedprice / CAST(100 AS DOUBLE) END AS net,
         CASE WHEN code IN (6, 7, 8) THEN -(l_extendedprice / CAST(100 AS DOUBLE)) * l_tax * 4
              ELSE CAST(0 AS DOUBLE) END AS tax,
         CAST(l_orderkey AS BIGINT) AS order_key,
         CAST(l_linenumber AS BIGINT) AS line_no,
         CAST(l_suppkey AS BIGINT) AS supp_key
  FROM li
  UNION ALL
  SELECT CAST(floor(p_partkey / 8) AS BIGINT),
         TIMESTAMP '2018-12-31 00:00:00',
         'Kauf',
         ({_ISIN_PREFIXES})[(p_partkey % 400) % 10 + 1] || lpad(CAST(p_partkey % 400 AS VARCHAR), 10, '0'),
         'Security ' || CAST(p_partkey % 400 AS VARCHAR),
         'EUR',
         CAST(100 AS DECIMAL(20,8)),
         -p_retailprice * 100,
         CAST(0 AS DOUBLE),
         CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM part
),
days AS (
  SELECT CAST(d AS DATE) AS rate_date
  FROM range(TIMESTAMP '2018-12-31', TIMESTAMP '2026-01-01', INTERVAL 1 DAY) t(d)
  WHERE year(d) < 2020 OR day(d) % 5 <> 0
),
rates_daily AS (
  SELECT rate_date, 'USD' AS currency,
         CAST(1050 + dayofyear(rate_date) % 40 AS DOUBLE) / CAST(1000 AS DOUBLE) AS rate FROM days
  UNION ALL
  SELECT rate_date, 'CHF', CAST(930 + dayofyear(rate_date) % 30 AS DOUBLE) / CAST(1000 AS DOUBLE) FROM days
),
yearly AS (
  SELECT y AS year, c AS currency, CAST(r AS DOUBLE) AS rate FROM (VALUES
    (2025, 'USD', 1.05), (2025, 'CHF', 0.93), (2025, 'EUR', 1.00),
    (2024, 'USD', 1.0825), (2024, 'CHF', 0.9525), (2024, 'EUR', 1.00),
    (2023, 'USD', 1.0812), (2023, 'CHF', 0.9718), (2023, 'EUR', 1.00),
    (2022, 'USD', 1.0534), (2022, 'CHF', 1.0048), (2022, 'EUR', 1.00),
    (2021, 'USD', 1.1829), (2021, 'CHF', 1.0811), (2021, 'EUR', 1.00),
    (2020, 'USD', 1.1421), (2020, 'CHF', 1.0706), (2020, 'EUR', 1.00)) v(y, c, r)
),
fx0 AS (
  SELECT l.*, year(l.ts) AS tax_year, d.rate AS d_rate, y.rate AS y_rate,
         CASE WHEN l.currency = 'EUR' THEN 'eur'
              WHEN d.rate IS NOT NULL THEN 'daily'
              WHEN year(l.ts) IS NULL OR year(l.ts) NOT IN (SELECT DISTINCT year FROM yearly) THEN 'missing'
              WHEN y.rate IS NOT NULL THEN 'yearly'
              ELSE 'assumed_1' END AS fx_source
  FROM ledger l
  LEFT JOIN rates_daily d ON d.rate_date = CAST(l.ts AS DATE) AND d.currency = l.currency
  LEFT JOIN yearly y ON y.year = year(l.ts) AND y.currency = l.currency
),
fx1 AS (
  SELECT *, CASE fx_source WHEN 'eur' THEN CAST(1 AS DOUBLE) WHEN 'daily' THEN d_rate
                           WHEN 'yearly' THEN y_rate WHEN 'assumed_1' THEN CAST(1 AS DOUBLE) END AS fx_rate
  FROM fx0
),
fx AS (
  SELECT *, net / fx_rate AS net_eur, tax / fx_rate AS tax_eur,
         net / fx_rate + coalesce(abs(tax / fx_rate), CAST(0 AS DOUBLE)) AS gross_eur
  FROM fx1
),
"""

_RULES = """rules AS (
  SELECT kind, key, source_country, tax_treatment, CAST(rate AS DOUBLE) AS max_creditable_rate,
         instrument, CAST(fund_type AS VARCHAR) AS fund_type
  FROM (VALUES ('country', 'CH', 'CH', 'foreign', 0.15, 'share', NULL),
               ('country', 'FR', 'FR', 'foreign', 0.128, 'share', NULL),
               ('country', 'GB', 'GB', 'foreign', 0.0, 'share', NULL),
               ('security', 'CH0000000001', 'US', 'foreign', 0.10, 'share', NULL))
       v(kind, key, source_country, tax_treatment, rate, instrument, fund_type)
  UNION ALL
  SELECT 'security', 'IE' || lpad(CAST(i AS VARCHAR), 10, '0'), 'IE', 'foreign', CAST(0 AS DOUBLE), 'fund',
         (['equity', 'mixed', 'real_estate', 'other', NULL])[(i // 10) % 5 + 1]
  FROM range(400) t(i) WHERE i % 10 = 4
),
"""

_INCOME = """income0 AS (
  SELECT f.*, upper(coalesce(f.isin, '')) AS rk,
         CASE WHEN f.type = 'Dividende' THEN 'dividend'
              WHEN f.type = 'Zinsen auf Einlagen' THEN 'interest'
              ELSE 'standalone' END AS scope
  FROM fx f
  WHERE f.type IN ('Dividende', 'Zinsen auf Einlagen', 'Steuerrückbehalt', 'Quellensteuer', 'Withholding Tax')
),
"""

_RESOLUTION = """ruled0 AS (
  SELECT i.*,
         s.source_country AS s_sc, s.tax_treatment AS s_tt, s.max_creditable_rate AS s_rate,
         s.instrument AS s_inst, s.fund_type AS s_ft, s.key AS s_key,
         c.source_country AS c_sc, c.tax_treatment AS c_tt, c.max_creditable_rate AS c_rate,
         c.instrument AS c_inst, c.fund_type AS c_ft, c.key AS c_key,
         upper(substr(i.rk, 1, 2)) AS pfx
  FROM {src} i
  LEFT JOIN (SELECT * FROM rules WHERE kind = 'security') s ON s.key = i.rk
  LEFT JOIN (SELECT * FROM rules WHERE kind = 'country') c ON c.key = substr(i.rk, 1, 2)
),
ruled1 AS (
  SELECT *,
         CASE WHEN rk = '' THEN NULL
              WHEN s_key IS NOT NULL THEN 'security'
              WHEN c_key IS NOT NULL THEN 'country'
              WHEN regexp_matches(pfx, '^\\p{{L}}{{2}}$') THEN 'default' END AS rule_origin
  FROM ruled0
),
ruled AS (
  SELECT *,
         CASE rule_origin WHEN 'security' THEN s_sc WHEN 'country' THEN c_sc WHEN 'default' THEN pfx END
           AS source_country,
         CASE rule_origin WHEN 'security' THEN s_tt WHEN 'country' THEN c_tt
              WHEN 'default' THEN CASE WHEN pfx = 'DE' THEN 'domestic' ELSE 'foreign' END END AS tax_treatment,
         CASE rule_origin WHEN 'security' THEN s_rate WHEN 'country' THEN c_rate
              WHEN 'default' THEN CASE WHEN pfx = 'DE' THEN CAST(0 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END END
           AS max_creditable_rate,
         CASE rule_origin WHEN 'security' THEN s_inst WHEN 'country' THEN c_inst WHEN 'default' THEN 'share' END
           AS instrument,
         CASE rule_origin WHEN 'security' THEN s_ft WHEN 'country' THEN c_ft END AS rule_fund_type
  FROM ruled1
),
"""

_REST = """cls1 AS (
  SELECT *,
         CASE WHEN scope = 'standalone' THEN abs(coalesce(net_eur, CAST(0 AS DOUBLE)))
              ELSE abs(coalesce(tax_eur, CAST(0 AS DOUBLE))) END AS raw_tax_eur
  FROM ruled
),
cls2 AS (
  SELECT *,
         CASE WHEN scope <> 'standalone' THEN
                CASE WHEN raw_tax_eur = 0 THEN 'none' WHEN rule_origin IS NULL THEN 'unclassified'
                     WHEN tax_treatment = 'domestic' THEN 'domestic' ELSE 'foreign' END
              ELSE
                CASE WHEN raw_tax_eur = 0 THEN 'none' WHEN tax_treatment = 'domestic' THEN 'domestic'
                     WHEN tax_treatment = 'foreign' THEN 'foreign_without_gross_income'
                     ELSE 'unclassified' END
         END AS treatment
  FROM cls1
),
cls3 AS (
  SELECT *,
         CASE WHEN treatment = 'foreign'
              THEN least(raw_tax_eur, (abs(coalesce(net_eur, CAST(0 AS DOUBLE))) + raw_tax_eur) * max_creditable_rate)
              ELSE CAST(0 AS DOUBLE) END AS credit_eur,
         CASE WHEN treatment = 'domestic' THEN raw_tax_eur ELSE CAST(0 AS DOUBLE) END AS domestic_eur,
         CASE WHEN treatment IN ('unclassified', 'foreign_without_gross_income') THEN raw_tax_eur
              ELSE CAST(0 AS DOUBLE) END AS unclassified_eur
  FROM cls2
),
cls4 AS (
  SELECT *,
         CASE WHEN treatment = 'foreign' THEN raw_tax_eur - credit_eur ELSE CAST(0 AS DOUBLE) END AS excess_eur,
         domestic_eur / CAST(1.055 AS DOUBLE) AS kest_eur
  FROM cls3
),
classified AS (
  SELECT *,
         domestic_eur - kest_eur AS soli_eur,
         CASE WHEN treatment = 'foreign' AND source_country = 'CH' THEN excess_eur ELSE CAST(0 AS DOUBLE) END
           AS swiss_refundable_eur,
         CASE WHEN scope <> 'dividend' THEN NULL
              WHEN rule_origin IS NOT NULL AND instrument = 'fund' THEN 'Anlage KAP-INV'
              WHEN (CASE WHEN rule_origin IS NOT NULL THEN source_country ELSE substr(rk, 1, 2) END) = 'DE'
                THEN 'Anlage KAP inländisch'
              ELSE 'Anlage KAP ausländisch' END AS form,
         CASE WHEN scope = 'dividend' AND rule_origin IS NOT NULL AND instrument = 'fund' THEN rule_fund_type END
           AS fund_type
  FROM cls4
),
trades AS (
  SELECT account_id, isin, ts, tax_year, quantity, net_eur, order_key, line_no, supp_key, net, tax, currency,
         CASE WHEN type = 'Kauf' THEN 0 ELSE 1 END AS side
  FROM fx WHERE type IN ('Kauf', 'Verkauf')
),
pos AS (
  SELECT *,
         sum(CASE WHEN side = 0 THEN quantity ELSE 0 END) OVER w AS cum_buy,
         sum(CASE WHEN side = 1 THEN quantity ELSE 0 END) OVER w AS cum_sell
  FROM trades
  WINDOW w AS (PARTITION BY account_id, isin
               ORDER BY ts NULLS FIRST, side, order_key, line_no, supp_key, quantity, net, tax, currency
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
flagged AS (
  SELECT *, coalesce(bool_or(side = 1 AND cum_sell > cum_buy) OVER k, FALSE) AS key_short,
         bool_or(isin IS NULL OR quantity IS NULL OR quantity <= 0 OR ts IS NULL OR net_eur IS NULL) OVER k AS key_bad
  FROM pos WINDOW k AS (PARTITION BY account_id, isin)
),
lots AS (
  SELECT account_id, isin, cum_buy - quantity AS b0, cum_buy AS b1, quantity AS lot_qty, -net_eur AS lot_cost
  FROM pos WHERE side = 0
),
sales AS (
  SELECT account_id, isin, ts, tax_year, order_key, line_no, supp_key, quantity, net, tax, currency,
         net_eur AS proceeds_eur,
         cum_sell - quantity AS s0, cum_sell AS s1,
         CASE WHEN cum_sell > cum_buy THEN least(quantity, cum_sell - cum_buy) END AS missing_qty,
         key_short AS shortfall, key_bad AS invalid
  FROM flagged WHERE side = 1
),
lot_sale AS (
  SELECT s.account_id, s.isin, s.s1, l.lot_cost, l.lot_qty, l.b1,
         greatest(s.s0, l.b0) AS m0, least(s.s1, l.b1) AS m1
  FROM sales s JOIN lots l
    ON l.account_id = s.account_id AND l.isin = s.isin AND l.b0 < s.s1 AND l.b1 > s.s0
),
cost_pro_rata AS (
  SELECT account_id, isin, s1,
         SUM(CAST(lot_cost * CAST(m1 - m0 AS DOUBLE) / CAST(lot_qty AS DOUBLE) AS DECIMAL(28,10))) AS c
  FROM lot_sale GROUP BY account_id, isin, s1
),
cost_as_observed AS (
  SELECT account_id, isin, s1,
         SUM(CAST(lot_cost * CAST(m1 - m0 AS DOUBLE) / CAST(b1 - m0 AS DOUBLE) AS DECIMAL(28,10))) AS c
  FROM lot_sale GROUP BY account_id, isin, s1
),
sales_pro_rata AS (
  SELECT s.*, CASE WHEN shortfall OR invalid THEN NULL ELSE CAST(c.c AS DOUBLE) END AS cost_eur
  FROM sales s LEFT JOIN cost_pro_rata c ON c.account_id = s.account_id AND c.isin = s.isin AND c.s1 = s.s1
),
sales_as_observed AS (
  SELECT s.*, CASE WHEN shortfall OR invalid THEN NULL ELSE CAST(c.c AS DOUBLE) END AS cost_eur
  FROM sales s LEFT JOIN cost_as_observed c ON c.account_id = s.account_id AND c.isin = s.isin AND c.s1 = s.s1
),
sold AS (
  SELECT *, proceeds_eur - cost_eur AS result_eur FROM sales_pro_rata
),
presence AS (SELECT DISTINCT account_id, tax_year FROM fx),
cls_tot AS (
  SELECT account_id, tax_year,
    SUM(CASE WHEN scope = 'dividend' AND form = 'Anlage KAP inländisch'
             THEN CAST(gross_eur AS DECIMAL(28,10)) END) AS domestic_share_dividends,
    SUM(CASE WHEN scope = 'dividend' AND form = 'Anlage KAP ausländisch'
             THEN CAST(gross_eur AS DECIMAL(28,10)) END) AS foreign_share_dividends,
    SUM(CASE WHEN scope = 'dividend' AND form = 'Anlage KAP-INV'
             THEN CAST(gross_eur AS DECIMAL(28,10)) END) AS fund_dividends,
    SUM(CASE WHEN scope = 'interest' THEN CAST(gross_eur AS DECIMAL(28,10)) END) AS interest,
    SUM(CAST(credit_eur AS DECIMAL(28,10))) AS credit,
    SUM(CAST(excess_eur AS DECIMAL(28,10))) AS excess,
    SUM(CAST(domestic_eur AS DECIMAL(28,10))) AS domestic,
    SUM(CAST(kest_eur AS DECIMAL(28,10))) AS kest,
    SUM(CAST(soli_eur AS DECIMAL(28,10))) AS soli,
    SUM(CAST(unclassified_eur AS DECIMAL(28,10))) AS unclassified,
    SUM(CAST(swiss_refundable_eur AS DECIMAL(28,10))) AS swiss_refundable,
    SUM(CASE WHEN scope = 'dividend' THEN CAST(credit_eur AS DECIMAL(28,10)) END) AS dividend_credit,
    SUM(CASE WHEN scope = 'interest' THEN CAST(credit_eur AS DECIMAL(28,10)) END) AS interest_credit,
    count(*) FILTER (WHERE scope = 'standalone') AS n_standalone
  FROM classified GROUP BY account_id, tax_year
),
sale_tot AS (
  SELECT account_id, tax_year,
    SUM(CAST(result_eur AS DECIMAL(28,10))) AS stock_result,
    SUM(CASE WHEN result_eur > 0 THEN CAST(result_eur AS DECIMAL(28,10)) END) AS stock_gains,
    SUM(CASE WHEN result_eur < 0 THEN CAST(result_eur AS DECIMAL(28,10)) END) AS stock_losses,
    count(*) FILTER (WHERE result_eur IS NOT NULL) AS n_sales,
    count(*) FILTER (WHERE result_eur IS NULL) AS n_flagged_sales
  FROM sold GROUP BY account_id, tax_year
),
totals AS (
  SELECT p.account_id, p.tax_year,
    coalesce(c.domestic_share_dividends, 0) AS domestic_share_dividends,
    coalesce(c.foreign_share_dividends, 0) AS foreign_share_dividends,
    coalesce(c.fund_dividends, 0) AS fund_dividends,
    coalesce(c.interest, 0) AS interest,
    coalesce(c.foreign_share_dividends, 0) + coalesce(c.interest, 0) AS foreign_capital_income,
    coalesce(c.credit, 0) AS credit, coalesce(c.excess, 0) AS excess, coalesce(c.domestic, 0) AS domestic,
    coalesce(c.kest, 0) AS kest, coalesce(c.soli, 0) AS soli, coalesce(c.unclassified, 0) AS unclassified,
    coalesce(c.swiss_refundable, 0) AS swiss_refundable,
    coalesce(c.dividend_credit, 0) AS dividend_credit, coalesce(c.interest_credit, 0) AS interest_credit,
    coalesce(s.stock_result, 0) AS stock_result, coalesce(s.stock_gains, 0) AS stock_gains,
    coalesce(s.stock_losses, 0) AS stock_losses,
    coalesce(s.n_sales, 0) AS n_sales, coalesce(s.n_flagged_sales, 0) AS n_flagged_sales,
    TRUE AS has_tax_info
  FROM presence p
  LEFT JOIN cls_tot c USING (account_id, tax_year)
  LEFT JOIN sale_tot s USING (account_id, tax_year)
),
form_lines AS (
  SELECT account_id, tax_year, 0 AS line_order, 'Anlage KAP' AS form, '18' AS line,
         'Inländische Kapitalerträge' AS label, domestic_share_dividends AS amount FROM totals
  UNION ALL SELECT account_id, tax_year, 1, 'Anlage KAP', '19', 'Ausländische Kapitalerträge',
         foreign_capital_income FROM totals
  UNION ALL SELECT account_id, tax_year, 2, 'Anlage KAP', '37', 'Kapitalertragsteuer', kest FROM totals
  UNION ALL SELECT account_id, tax_year, 3, 'Anlage KAP', '38', 'Solidaritätszuschlag', soli FROM totals
  UNION ALL SELECT account_id, tax_year, 4, 'Anlage KAP', '41', 'Anrechenbare ausl. Quellensteuer', credit FROM totals
  UNION ALL SELECT account_id, tax_year, 5, 'Anlage KAP', '20', 'Aktiengewinne', stock_gains FROM totals
  UNION ALL SELECT account_id, tax_year, 6, 'Anlage KAP', '23', 'Aktienverluste', stock_losses FROM totals
  UNION ALL SELECT account_id, tax_year, 7, 'Anlage KAP-INV', '4', 'Investmentfonds-Ausschüttungen',
         fund_dividends FROM totals
  UNION ALL SELECT account_id, tax_year, 8, 'eF85 (ESTV)', '—', 'CH-Verrechnungssteuer Rückforderung',
         swiss_refundable FROM totals WHERE swiss_refundable > 0
),
by_country AS (
  SELECT account_id, tax_year, scope, source_country, SUM(CAST(credit_eur AS DECIMAL(28,10))) AS credit
  FROM classified WHERE treatment IN ('foreign', 'foreign_without_gross_income')
  GROUP BY account_id, tax_year, scope, source_country
  UNION ALL
  SELECT account_id, tax_year, 'total', source_country, SUM(CAST(credit_eur AS DECIMAL(28,10)))
  FROM classified WHERE treatment IN ('foreign', 'foreign_without_gross_income')
  GROUP BY account_id, tax_year, source_country
)
"""

BASE = _HEAD + _RULES + _INCOME + _RESOLUTION.format(src="income0") + _REST


def _r4(x: str) -> str:
    return f"CAST(ROUND({x}, 4) AS DOUBLE)"


def _r4sum(x: str) -> str:
    return f"CAST(ROUND(SUM(CAST({x} AS DECIMAL(28,10))), 4) AS DOUBLE)"


def _r4row(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), 4) AS DOUBLE)"


_CLASS_SUMS = ("raw_tax_eur", "credit_eur", "excess_eur", "domestic_eur", "kest_eur", "soli_eur",
               "unclassified_eur", "swiss_refundable_eur")

_CLASS_GROUPS = (
    "SELECT account_id, tax_year, scope, source_country, treatment, count(*) AS n_rows, "
    + _r4sum("gross_eur") + " AS sum_gross_eur, "
    + ", ".join(f"{_r4sum(c)} AS sum_{c}" for c in _CLASS_SUMS)
    + " FROM classified WHERE {where} GROUP BY account_id, tax_year, scope, source_country, treatment"
)

_SALES_OUT = """
SELECT account_id, isin, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sale_ts, tax_year, order_key, line_no, supp_key,
       CAST(quantity AS DOUBLE) AS quantity,
       {proceeds} AS proceeds_eur, {cost} AS cost_eur, {result} AS result_eur,
       CAST(shortfall AS BIGINT) AS shortfall, CAST(missing_qty AS DOUBLE) AS missing_qty
FROM {src}
"""


def _sales_sql(src: str) -> str:
    body = _SALES_OUT.format(
        proceeds=_r4row("proceeds_eur"),
        cost=_r4row("cost_eur"),
        result=_r4row("proceeds_eur - cost_eur"),
        src=src,
    )
    return BASE + body


_SUMMARY_FIGS = ("credit", "excess", "domestic", "kest", "soli", "unclassified", "swiss_refundable")
_SUMMARY_SUMS = ", ".join(
    f"{_r4sum(f + '_eur')} AS {f}" for f in _SUMMARY_FIGS
)

# position, figure, condition
_POSITIONS = (
    ("1.kap18", "domestic_share_dividends", "TRUE",
     "Anlage KAP (Zeile 18 - Inländische Kapitalerträge, deutsche Aktien)"),
    ("1.kap19_dividends", "foreign_share_dividends", "TRUE",
     "Anlage KAP (Zeile 19 - Ausländische Kapitalerträge, ausländische Aktien)"),
    ("1.kapinv4", "fund_dividends", "TRUE", "Anlage KAP-INV (Zeile 4 - Investmentfonds-/ETF-Ausschüttungen)"),
    ("2.kap19_interest", "interest", "TRUE", "Anlage KAP (Zeile 19 - Ausländische Zinsen)"),
    ("3.kap41", "credit", "has_tax_info", "Anlage KAP (Zeile 41 - Anrechenbare ausländische Steuern)"),
    ("3.dividend_credit", "dividend_credit", "has_tax_info", "Davon Quellensteuer auf Dividenden"),
    ("3.interest_credit", "interest_credit", "has_tax_info", "Davon Quellensteuer auf Zinsen"),
    ("3.excess", "excess", "has_tax_info AND excess <> 0", "Nicht anrechenbarer ausländischer Steuerüberhang"),
    ("3.swiss_refundable", "swiss_refundable", "has_tax_info AND swiss_refundable <> 0",
     "Davon Schweizer Verrechnungssteuer, separat rückforderbar"),
    ("4.kest", "kest", "has_tax_info", "Zeile 37 - Kapitalertragsteuer"),
    ("4.soli", "soli", "has_tax_info", "Zeile 38 - Solidaritätszuschlag"),
    ("4.domestic", "domestic", "has_tax_info", "Summe deutsche Kapitalertragsteuer einschließlich Soli"),
    ("4.unclassified", "unclassified", "has_tax_info AND unclassified <> 0",
     "Nicht in Zeile 41 (fehlende ISIN-Regel oder Bruttobetrag)"),
    ("5.stock_result", "stock_result", "TRUE", "Realisierte Gewinne/Verluste aus Aktienverkäufen"),
    ("5.no_sales", None, "n_sales = 0",
     "Anlage KAP: Keine Eintragung für Aktienverkäufe (keine Verkaufstransaktionen)."),
    ("5.stock_gains", "stock_gains", "n_sales > 0 AND stock_gains <> 0", "Davon Aktiengewinne (separates Formularfeld)"),
    ("5.stock_losses", "stock_losses", "n_sales > 0 AND stock_losses <> 0",
     "Davon Aktienverluste (separates Formularfeld)"),
)


def _positions_sql() -> str:
    parts = []
    for pos, fig, cond, label in _POSITIONS:
        amount = _r4(fig) if fig else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT account_id, tax_year, '{pos}' AS position, '{label}' AS label, {amount} AS amount "
            f"FROM totals WHERE {cond}"
        )
    parts.append(
        "SELECT account_id, tax_year, '3.country.' || coalesce(source_country, '') AS position, "
        "coalesce(source_country, '') AS label, " + _r4("credit") + " AS amount FROM by_country WHERE scope = 'total'"
    )
    return BASE + "\nUNION ALL\n".join(parts)


_DETAIL_INCOME = """
SELECT '{cat}' AS category, account_id, tax_year, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, isin, type, currency,
       order_key, line_no, supp_key,
       {net} AS net, {net_eur} AS net_eur, {tax_eur} AS tax_eur, {gross_eur} AS gross_eur,
       form, fund_type, source_country, treatment,
       {credit} AS credit_eur, {excess} AS excess_eur, {kest} AS kest_eur, {soli} AS soli_eur,
       {uncl} AS unclassified_eur,
       CAST(quantity AS DOUBLE) AS quantity,
       CAST(NULL AS DOUBLE) AS proceeds_eur, CAST(NULL AS DOUBLE) AS cost_eur, CAST(NULL AS DOUBLE) AS result_eur
FROM classified WHERE scope = '{scope}'
"""

_DETAIL_SALES = """
SELECT 'Aktienverkauf' AS category, account_id, tax_year, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, isin,
       CAST(NULL AS VARCHAR) AS type, currency, order_key, line_no, supp_key,
       {net} AS net, CAST(NULL AS DOUBLE) AS net_eur, CAST(NULL AS DOUBLE) AS tax_eur,
       CAST(NULL AS DOUBLE) AS gross_eur,
       CAST(NULL AS VARCHAR) AS form, CAST(NULL AS VARCHAR) AS fund_type, CAST(NULL AS VARCHAR) AS source_country,
       CAST(NULL AS VARCHAR) AS treatment,
       CAST(NULL AS DOUBLE) AS credit_eur, CAST(NULL AS DOUBLE) AS excess_eur, CAST(NULL AS DOUBLE) AS kest_eur,
       CAST(NULL AS DOUBLE) AS soli_eur, CAST(NULL AS DOUBLE) AS unclassified_eur,
       CAST(quantity AS DOUBLE) AS quantity,
       {proceeds} AS proceeds_eur, {cost} AS cost_eur, {result} AS result_eur
FROM sold
"""


def _detail_sql() -> str:
    inc = dict(
        net=_r4row("net"),
        net_eur=_r4row("net_eur"),
        tax_eur=_r4row("tax_eur"),
        gross_eur=_r4row("gross_eur"),
        credit=_r4row("credit_eur"),
        excess=_r4row("excess_eur"),
        kest=_r4row("kest_eur"),
        soli=_r4row("soli_eur"),
        uncl=_r4row("unclassified_eur"),
    )
    div = _DETAIL_INCOME.format(cat="Dividende", scope="dividend", **inc)
    intr = _DETAIL_INCOME.format(cat="Zinsen", scope="interest", **inc)
    sal = _DETAIL_SALES.format(
        net=_r4row("net"), proceeds=_r4row("proceeds_eur"), cost=_r4row("cost_eur"), result=_r4row("result_eur")
    )
    return BASE + div + "UNION ALL" + intr + "UNION ALL" + sal


_ISSUE_CHECKS = (
    ("missing_account", "account_id IS NULL"),
    ("missing_amount", "net IS NULL"),
    ("missing_currency", "currency IS NULL"),
    ("missing_type", "type IS NULL"),
    ("bad_date", "ts IS NULL"),
    ("unknown_currency", "currency IS NOT NULL AND currency NOT IN ('USD', 'CHF', 'EUR')"),
    ("fx_rate_missing", "fx_source = 'missing'"),
    ("trade_missing_isin", "type IN ('Kauf', 'Verkauf') AND isin IS NULL"),
    ("trade_missing_quantity", "type IN ('Kauf', 'Verkauf') AND quantity IS NULL"),
    ("trade_bad_quantity", "type IN ('Kauf', 'Verkauf') AND quantity <= 0"),
)
_FIFO_CHECKS = (
    ("fifo_shortfall", "shortfall AND missing_qty IS NOT NULL"),
    ("fifo_key_shortfall", "shortfall"),
    ("fifo_invalid_key", "invalid"),
)


_FAULTY_LEDGER = """ledger AS (
  SELECT CASE WHEN f = 1 THEN NULL ELSE account_id END AS account_id,
         CASE WHEN f = 5 THEN NULL WHEN f = 10 THEN ts - INTERVAL 30 YEAR ELSE ts END AS ts,
         CASE WHEN f = 4 THEN NULL ELSE type END AS type,
         CASE WHEN f = 7 THEN NULL ELSE isin END AS isin,
         name,
         CASE WHEN f = 3 THEN NULL WHEN f = 6 THEN 'GBP' ELSE currency END AS currency,
         CASE WHEN f = 8 THEN NULL WHEN f = 9 THEN -quantity ELSE quantity END AS quantity,
         CASE WHEN f = 2 THEN NULL ELSE net END AS net,
         tax, order_key, line_no, supp_key
  FROM (SELECT *, order_key % 97 AS f FROM clean_ledger)
),
"""
FAULTY_BASE = BASE.replace("ledger AS (", "clean_ledger AS (", 1).replace("days AS (", _FAULTY_LEDGER + "days AS (", 1)


def _issue_rows() -> str:
    parts = [
        f"SELECT account_id, '{name}' AS issue, count(*) FILTER (WHERE {pred}) AS n FROM fx GROUP BY account_id"
        for name, pred in _ISSUE_CHECKS
    ] + [
        f"SELECT account_id, '{name}' AS issue, count(*) FILTER (WHERE {pred}) AS n "
        "FROM sales_pro_rata GROUP BY account_id"
        for name, pred in _FIFO_CHECKS
    ]
    return "SELECT account_id, issue, CAST(n AS BIGINT) AS n FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE n > 0"


def _data_issue_rows(checks, table: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT account_id, '{name}' AS issue, count(*) FILTER (WHERE {pred}) AS n FROM {table} GROUP BY account_id"
        for name, pred in checks
    )


_MALFORMED = "order_key % 89 IN (1, 2)"

_BAD_ROWS = f"""
, named AS (
{" UNION ALL ".join(f"SELECT fx.*, '{name}' AS issue FROM fx WHERE {pred}" for name, pred in _ISSUE_CHECKS)}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id, issue
    ORDER BY ts NULLS FIRST, order_key, line_no, supp_key, quantity NULLS FIRST, net NULLS FIRST, tax, currency NULLS FIRST) AS nth
  FROM named)
SELECT account_id, issue, nth, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, type, isin, currency,
       CAST(ROUND(CAST(net AS DECIMAL(28,10)), 4) AS DOUBLE) AS net, order_key, line_no, supp_key
FROM ranked WHERE nth <= 3
"""

_LINES_OUT = f"""
SELECT account_id, tax_year, CAST(line_order AS BIGINT) AS line_order, form, line, label, {_r4('amount')} AS amount
FROM form_lines"""

_RULE_FAULTS = (
    ("bad_kind", "kind NOT IN ('security', 'country')"),
    ("missing_key", "key = ''"),
    ("missing_field", "source_country IS NULL"),
    ("bad_rate_type", "rate IS NULL"),
    ("bad_treatment", "treatment NOT IN ('domestic', 'foreign')"),
    ("rate_out_of_range", "rate < 0 OR rate > 1"),
    ("domestic_with_credit", "treatment = 'domestic' AND rate <> 0"),
    ("bad_instrument", "instrument NOT IN ('share', 'fund')"),
    ("bad_fund_type", "fund_type NOT IN ('equity', 'mixed', 'real_estate', 'other')"),
    ("fund_type_without_fund", "fund_type IS NOT NULL AND instrument <> 'fund'"),
)


def _rules_issues_sql() -> str:
    rows = "\nUNION ALL\n".join(f"SELECT kind, key, '{name}' AS issue FROM r WHERE {pred}" for name, pred in _RULE_FAULTS)
    return f"""
WITH p AS (SELECT p_partkey % 300 AS sec, p_partkey % 13 AS f FROM part),
r AS (
  SELECT CASE WHEN f = 1 THEN 'share' ELSE 'security' END AS kind,
         CASE WHEN f = 2 THEN '' ELSE ({_ISIN_PREFIXES})[sec % 10 + 1] || lpad(CAST(sec AS VARCHAR), 10, '0') END AS key,
         CASE WHEN f = 3 THEN NULL ELSE 'US' END AS source_country,
         CASE f WHEN 4 THEN 'exempt' WHEN 5 THEN 'domestic' ELSE 'foreign' END AS treatment,
         CASE f WHEN 6 THEN CAST(1.5 AS DOUBLE) WHEN 7 THEN NULL ELSE CAST(0.15 AS DOUBLE) END AS rate,
         CASE f WHEN 8 THEN 'bond' WHEN 9 THEN 'fund' ELSE 'share' END AS instrument,
         CASE f WHEN 9 THEN 'exotic' WHEN 10 THEN 'equity' END AS fund_type
  FROM p)
SELECT kind, key, issue, count(*) AS n_rules FROM (
{rows}
UNION ALL
SELECT kind, key, 'duplicate_key' FROM r GROUP BY kind, key HAVING count(*) > 1
) GROUP BY kind, key, issue
"""


_FUND_BREAKDOWN = BASE + f"""
SELECT account_id, tax_year, ft AS fund_type,
       CASE ft WHEN 'equity' THEN 'Aktienfonds (≥51% Aktien)' WHEN 'mixed' THEN 'Mischfonds (≥25% Aktien)'
               WHEN 'real_estate' THEN 'Immobilienfonds (≥51% Immobilien)' WHEN 'other' THEN 'Sonstige Fonds'
               ELSE 'Fonds (Typ: ' || ft || ')' END AS fund_label,
       rate AS exemption_rate,
       {_r4('g')} AS gross_total,
       {_r4('g * CAST(CAST(1 AS DOUBLE) - rate AS DECIMAL(5,4))')} AS taxable
FROM (
  SELECT account_id, tax_year, coalesce(fund_type, 'other') AS ft,
         CAST(SUM(CAST(gross_eur AS DECIMAL(28,10))) AS DECIMAL(30,10)) AS g,
         CASE coalesce(fund_type, 'other') WHEN 'equity' THEN CAST(0.30 AS DOUBLE)
              WHEN 'mixed' THEN CAST(0.15 AS DOUBLE) WHEN 'real_estate' THEN CAST(0.60 AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS rate
  FROM classified WHERE form = 'Anlage KAP-INV' GROUP BY account_id, tax_year, coalesce(fund_type, 'other')
)
"""


def _open_lots_sql(open_cost: str) -> str:
    """Ranges on the quantity axis: what of a lot lies above all that was sold of its key."""
    return BASE + f"""
, sold_of_key AS (SELECT account_id, isin, sum(quantity) AS total FROM pos WHERE side = 1 GROUP BY account_id, isin),
left_over AS (
  SELECT f.*, key_short OR key_bad AS flagged, -net_eur AS cost,
         CASE WHEN NOT (key_short OR key_bad)
              THEN greatest(0, cum_buy - greatest(cum_buy - quantity, coalesce(total, 0))) END AS remaining
  FROM flagged f LEFT JOIN sold_of_key s ON s.account_id = f.account_id AND s.isin = f.isin
  WHERE side = 0)
SELECT account_id, isin, strftime(ts, '%Y-%m-%d %H:%M:%S') AS buy_ts, order_key, line_no, supp_key,
       CAST(quantity AS DOUBLE) AS lot_qty, CAST(remaining AS DOUBLE) AS remaining, {open_cost} AS open_cost_eur,
       CAST(key_short AS BIGINT) AS shortfall
FROM left_over WHERE flagged OR remaining > 0
"""


ORACLE_SQL: dict[str, str] = {
    "fx_convert": BASE + f"""
SELECT account_id, tax_year, fx_source, count(*) AS n_rows,
       {_r4sum('net_eur')} AS sum_net_eur, {_r4sum('tax_eur')} AS sum_tax_eur, {_r4sum('gross_eur')} AS sum_gross_eur
FROM fx GROUP BY account_id, tax_year, fx_source
""",
    "gross_income": BASE + f"""
SELECT account_id, tax_year, scope, count(*) AS n_rows,
       {_r4sum('net_eur')} AS sum_net_eur, {_r4sum('gross_eur')} AS sum_gross_eur
FROM classified GROUP BY account_id, tax_year, scope
""",
    "rule_resolution": (
        _HEAD
        + _RULES
        + "isins AS (SELECT DISTINCT isin, upper(coalesce(isin, '')) AS rk FROM ledger),\n"
        + _RESOLUTION.format(src="isins").rstrip().rstrip(",")
        + """
SELECT isin, source_country, tax_treatment, max_creditable_rate, instrument, rule_fund_type AS fund_type, rule_origin
FROM ruled
"""
    ),
    "classify_embedded": BASE + _CLASS_GROUPS.format(where="scope IN ('dividend', 'interest')"),
    "classify_standalone": BASE + _CLASS_GROUPS.format(where="scope = 'standalone'"),
    "tax_summary": BASE + f"""
SELECT account_id, tax_year, scope, count(*) AS n_rows, {_SUMMARY_SUMS}
FROM classified GROUP BY account_id, tax_year, scope
UNION ALL
SELECT account_id, tax_year, 'total', count(*), {_SUMMARY_SUMS}
FROM classified GROUP BY account_id, tax_year
""",
    "credit_by_country": BASE + f"""
SELECT account_id, tax_year, scope, source_country, {_r4('credit')} AS credit FROM by_country
""",
    "dividend_forms": BASE + f"""
SELECT account_id, tax_year, form, fund_type, count(*) AS n_rows, {_r4sum('gross_eur')} AS sum_gross_eur
FROM classified WHERE scope = 'dividend' GROUP BY account_id, tax_year, form, fund_type
""",
    "fund_breakdown": _FUND_BREAKDOWN,
    "fifo_realized": _sales_sql("sales_pro_rata"),
    "fifo_realized_as_observed": _sales_sql("sales_as_observed"),
    "fifo_bucketed": _sales_sql("sales_pro_rata"),
    "fifo_shortfall": BASE + """
SELECT account_id, isin, count(*) AS n_short_sales,
       strftime(arg_min(ts, (ts, side, order_key, line_no, supp_key, quantity, net, tax, currency)),
                '%Y-%m-%d %H:%M:%S') AS first_short_ts,
       CAST(arg_min(least(quantity, cum_sell - cum_buy),
                    (ts, side, order_key, line_no, supp_key, quantity, net, tax, currency)) AS DOUBLE)
         AS first_missing_qty,
       CAST(max(least(quantity, cum_sell - cum_buy)) AS DOUBLE) AS max_missing_qty
FROM pos WHERE side = 1 AND cum_sell > cum_buy
GROUP BY account_id, isin
""",
    "stock_result_split": BASE + f"""
SELECT account_id, tax_year, {_r4('stock_result')} AS stock_result, {_r4('stock_gains')} AS stock_gains,
       {_r4('stock_losses')} AS stock_losses, CAST(n_sales AS BIGINT) AS n_sales,
       CAST(n_flagged_sales AS BIGINT) AS n_flagged_sales, CAST(n_sales > 0 AS BIGINT) AS has_sales
FROM totals
""",
    "form_lines": BASE + _LINES_OUT,
    "form_lines_quarantine": BASE + ", issue_rows AS (" + _issue_rows() + ")" + _LINES_OUT + """ f
WHERE NOT EXISTS (SELECT 1 FROM issue_rows i WHERE i.account_id IS NOT DISTINCT FROM f.account_id)
""",
    "form_lines_of_year": BASE + _LINES_OUT + " WHERE tax_year = 2021",
    "report_positions": _positions_sql(),
    "detail_sections": BASE + f"""
SELECT account_id, tax_year, section,
       CASE section WHEN 'dividend' THEN 'Details Dividenden' WHEN 'interest' THEN 'Details Zinsen'
                    WHEN 'standalone' THEN 'Details separate Quellensteuer-Buchungen'
                    ELSE 'Details Aktienverkäufe' END AS title,
       count(*) AS n_rows, {_r4('coalesce(SUM(CAST(amount AS DECIMAL(28,10))), 0)')} AS total
FROM (
  SELECT account_id, tax_year, scope AS section,
         CASE WHEN scope = 'standalone' THEN net_eur ELSE gross_eur END AS amount
  FROM classified
  UNION ALL
  SELECT account_id, tax_year, 'sale', result_eur FROM sold
) GROUP BY account_id, tax_year, section
""",
    "display_amounts": BASE + """
SELECT account_id, tax_year, CAST(line_order AS BIGINT) AS line_order,
       CAST(round_even(amount, 2) AS DOUBLE) AS display,
       printf('%.2f EUR', CAST(round_even(amount, 2) AS DOUBLE)) AS display_text
FROM form_lines
""",
    "display_whole_euros": BASE + """
SELECT account_id, tax_year, CAST(line_order AS BIGINT) AS line_order,
       CAST(round_even(amount, 0) AS DOUBLE) AS display,
       printf('%.0f EUR', CAST(round_even(amount, 0) AS DOUBLE)) AS display_text
FROM form_lines
""",
    "detail_export": _detail_sql(),
    "ledger_issues": FAULTY_BASE + _issue_rows(),
    "rules_issues": _rules_issues_sql(),
    "tax_years": BASE + """
SELECT account_id, CAST(count(DISTINCT year(ts)) AS BIGINT) AS n_years,
       CAST(min(year(ts)) AS BIGINT) AS min_year, CAST(max(year(ts)) AS BIGINT) AS max_year,
       string_agg(DISTINCT CAST(year(ts) AS VARCHAR), ',' ORDER BY CAST(year(ts) AS VARCHAR)) AS years,
       CAST(count(DISTINCT year(ts)) > 1 AS BIGINT) AS multi_year
FROM ledger GROUP BY account_id
""",
    "ledger_scan": BASE + f"""
SELECT account_id, year(ts) AS tax_year, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_ts,
       {_r4sum('net')} AS sum_net, {_r4sum('tax')} AS sum_tax,
       CAST(SUM(quantity) AS DOUBLE) AS sum_quantity, count(DISTINCT isin) AS n_isins
FROM ledger GROUP BY account_id, year(ts)
""",
    "ledger_scan_mixed": BASE + f"""
SELECT account_id, year(ts) AS tax_year, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_ts,
       {_r4sum('net')} AS sum_net, CASE WHEN account_id % 3 <> 2 THEN {_r4sum('tax')} END AS sum_tax,
       CAST(SUM(quantity) AS DOUBLE) AS sum_quantity, count(DISTINCT isin) AS n_isins
FROM ledger GROUP BY account_id, year(ts)
""",
    "ledger_scan_issues": BASE + f"""
, well AS (SELECT * FROM fx WHERE NOT ({_MALFORMED}))
SELECT account_id, issue, CAST(n AS BIGINT) AS n FROM (
{_data_issue_rows(_ISSUE_CHECKS, "well")}
UNION ALL
SELECT account_id, 'malformed_row', count(*) FILTER (WHERE {_MALFORMED}) FROM fx GROUP BY account_id
) WHERE n > 0
""",
    "bad_rows": FAULTY_BASE + _BAD_ROWS,
    "open_lots": _open_lots_sql(f"CASE WHEN NOT flagged THEN {_r4row('cost * CAST(remaining AS DOUBLE) / CAST(quantity AS DOUBLE)')} END"),
    "open_lots_as_observed": _open_lots_sql(f"CASE WHEN NOT flagged THEN {_r4row('cost')} END"),
    "fifo_from_lots": (
        f"SELECT * EXCLUDE (missing_qty) FROM ({_sales_sql('sales_pro_rata')}) WHERE tax_year >= 2022"
    ),
    "report_sink": f"""
SELECT account_id, tax_year, 'line' AS kind, line AS item, amount FROM ({BASE + _LINES_OUT})
WHERE tax_year IN (2021, 2022)
UNION ALL
SELECT account_id, tax_year, 'country', scope || ':' || coalesce(source_country, ''), {_r4('credit')}
FROM ({BASE} SELECT * FROM by_country) WHERE tax_year IN (2021, 2022)
UNION ALL
SELECT account_id, tax_year, 'fund', fund_type, taxable FROM ({_FUND_BREAKDOWN}) WHERE tax_year IN (2021, 2022)
UNION ALL
SELECT account_id, tax_year, 'position', position, amount FROM ({_positions_sql()}) WHERE tax_year IN (2021, 2022)
""",
    "detail_sink": BASE + f"""
SELECT category, account_id, tax_year, count(*) AS n_rows,
       {_r4sum('gross_eur')} AS sum_gross_eur, {_r4sum('result_eur')} AS sum_result_eur
FROM (
  SELECT CASE scope WHEN 'dividend' THEN 'Dividende' ELSE 'Zinsen' END AS category, account_id, tax_year, gross_eur,
         CAST(NULL AS DOUBLE) AS result_eur
  FROM classified WHERE scope IN ('dividend', 'interest')
  UNION ALL
  SELECT 'Aktienverkauf', account_id, tax_year, NULL, result_eur FROM sold
) GROUP BY category, account_id, tax_year
""",
    "rate_payloads": """
WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS rate_date FROM lineitem),
p AS (SELECT rate_date, (dayofyear(rate_date) * 7 % 400) * 100 + 37 AS part FROM d)
SELECT rate_date, 'USD' AS currency, CAST(round((1050000 + part) / CAST(1000000 AS DECIMAL(18,6)), 4) AS DOUBLE) AS rate FROM p
UNION ALL
SELECT rate_date, 'CHF', CAST(round((900000 + part) / CAST(1000000 AS DECIMAL(18,6)), 4) AS DOUBLE) FROM p
UNION ALL
SELECT rate_date, 'EUR', CAST(1 AS DOUBLE) FROM p
""",
}
