"""kapspark: German capital-income tax figures from brokerage ledgers, on Spark.

One job computes every (account_id, tax_year) of a ledger table: FX to EUR,
gross-up, rule resolution, withholding-tax split, FIFO realised results and
the form lines, all as DataFrame plans (see ``plans.tax_run.calculate``).
"""

from kapspark.config import TaxConfig
from kapspark.plans.tax_run import TaxResult, calculate

__all__ = ["TaxConfig", "TaxResult", "calculate"]
