"""Trend, seasons, holidays and outside inputs added up, one model per cluster.

Trend bends have a Laplace prior of width 0.05, so that most of them are exactly 0; all other effects
have normal priors of width 10. The number of bends (25 over the first 80 % of the training span) and
the yearly and weekly orders (10 and 3) follow Taylor and Letham (2018); a yearly season needs two
years of data and a weekly one two weeks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.dates import fourier_terms, with_holiday_columns
from gridlens.models.linalg import gram, predict, solve
from gridlens.operators import series as S
from gridlens.session import cut_lineage

BENDS, BEND_SPAN = 25, 0.8
BEND_PRIOR, TREND_PRIOR, EFFECT_PRIOR = 0.05, 5.0, 10.0
YEARLY, WEEKLY, DAILY = (365.25, 10), (7.0, 3), (1.0, 15)
NOISE = 0.1


@dataclass(frozen=True)
class Design:
    """What fit and prediction must agree on."""

    start: datetime
    end: datetime
    inputs: tuple[str, ...]

    @property
    def days(self) -> float:
        return max((self.end - self.start).total_seconds() / 86400.0, 1e-9)

    def columns(self, time: str):
        origin = S.epoch(F.lit(self.start).cast("timestamp_ntz"))
        t = (S.epoch(time) - origin) / F.lit(self.days * 86400.0)
        trend = [t.alias("trend")]
        bends = [
            F.greatest(F.lit(0.0), t - F.lit(BEND_SPAN * k / BENDS)).alias(f"bend_{k}")
            for k in range(1, BENDS + 1)
        ]
        seasons = fourier_terms(time, *DAILY, "daily")
        if self.days >= 14:
            seasons += fourier_terms(time, *WEEKLY, "weekly")
        if self.days >= 730:
            seasons += fourier_terms(time, *YEARLY, "yearly")
        return trend, bends, seasons

    def apply(self, df: DataFrame, cluster: str, time: str, keep: Sequence[str]):
        trend, bends, effects = self.columns(time)
        dated, holidays = with_holiday_columns(df, time)
        wide = dated.select(
            cluster, time, *keep, *self.inputs, *holidays, *trend, *bends, *effects
        )
        names = [c for c in wide.columns if c not in (cluster, time, *keep)]
        return wide, names


def design_for(train: DataFrame, inputs: Sequence[str], time: str = "Date") -> Design:
    lo, hi = train.agg(F.min(time), F.max(time)).first()
    return Design(lo, hi, tuple(inputs))


def _weights(names: Sequence[str]) -> tuple[list[float], list[float]]:
    """Ridge weight and weight on the absolute value of each effect's coefficient."""
    widths = {"trend": TREND_PRIOR}
    bent = [n.startswith("bend_") for n in names]
    ridge = [0.0 if b else NOISE / widths.get(n, EFFECT_PRIOR) ** 2 for n, b in zip(names, bent)]
    return ridge, [NOISE / BEND_PRIOR if b else 0.0 for b in bent]


def fit(train: DataFrame, design: Design, target: str = "Consumption_Scaled",
        cluster: str = "Cluster", time: str = "Date") -> DataFrame:
    wide, names = design.apply(train, cluster, time, [target])
    ridge, absolute = _weights(names)
    sums = gram(wide, [cluster], names, [target])
    return solve(sums, [cluster], len(names), [target], ridge, absolute=absolute).drop("target")


def bends(coefs: DataFrame, design: Design, cluster: str = "Cluster", time: str = "Date") -> DataFrame:
    """Rows (cluster, bend, at, change) of the bends that the fit uses: the number and stamp of the
    bend, and by how much the slope changes there, per day."""
    # Bends stand before the seasons, which come last.
    first = F.size("coef") - len(design.columns(time)[2]) - BENDS + 1
    at = S.epoch(F.lit(design.start).cast("timestamp_ntz")) + F.lit(design.days * 86400.0 * BEND_SPAN / BENDS) * F.col("bend")
    long = coefs.select(cluster, F.posexplode(F.slice("coef", first, F.lit(BENDS))).alias("bend", "change"))
    return long.filter("change != 0").withColumn("bend", F.col("bend") + 1).select(
        cluster, "bend", F.timestamp_seconds(at).cast("timestamp_ntz").alias("at"),
        (F.col("change") / F.lit(design.days)).alias("change"),
    )


def optimality(train: DataFrame, design: Design, coefs: DataFrame, target: str = "Consumption_Scaled",
               cluster: str = "Cluster", time: str = "Date", tolerance: float = 1e-6) -> DataFrame:
    """Does each cluster's fit meet the conditions of a minimum? Rows (cluster, n_bends, optimal).

    The pull of the residuals on an effect must equal its ridge weight times its coefficient, on a
    bend in use its weight with the coefficient's sign, and on an unused bend not exceed that weight.
    """
    wide, names = design.apply(train, cluster, time, [target])
    ridge, absolute = _weights(names)
    # Written once: each of the sums below would work out all effects anew.
    fitted = predict(cut_lineage(wide.na.drop()), coefs, [cluster], names, "_fit")
    rest = cut_lineage(fitted.withColumn("_r", F.col(target) - F.col("_fit")))
    pulls = rest.groupBy(cluster).agg(
        F.sum(F.abs("_r")).alias("_size"), F.abs(F.sum("_r")).alias("_sum"),
        *[F.sum(F.col("_r") * F.col(n)).alias(f"_p{i}") for i, n in enumerate(names)],
    )
    judged = pulls.join(coefs.select(cluster, "coef"), cluster)
    allowed = F.lit(tolerance) * (F.lit(1.0) + F.col("_size"))
    fine = F.col("_sum") <= allowed
    used = F.lit(0)
    for i, (r, a) in enumerate(zip(ridge, absolute)):
        pull, c = F.col(f"_p{i}"), F.col("coef")[i]
        if a:
            fine &= F.when(c != 0, F.abs(pull - F.signum(c) * a) <= allowed).otherwise(F.abs(pull) <= a + allowed)
            used += (c != 0).cast("int")
        else:
            fine &= F.abs(pull - c * r) <= allowed
    return judged.select(cluster, used.alias("n_bends"), fine.alias("optimal"))


def forecast(coefs: DataFrame, design: Design, future: DataFrame, cluster: str = "Cluster",
             time: str = "Date", keep: Sequence[str] = (),
             out: str = "Predicted_Consumption_Scaled") -> DataFrame:
    """``future`` holds cluster, stamp and the outside inputs."""
    wide, names = design.apply(future, cluster, time, keep)
    return predict(wide, coefs, [cluster], names, out).select(cluster, time, *keep, out)
