"""Panels, audits and encoders: the object interface over scored users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia import errors
from concordia.operators import panel as reports
from concordia.plans import inference, score, structure
from concordia.schema import METRICS
from concordia.sources import ingest


class Panel:
    """Budget rows (user_id, obs) of many users, with an optional period."""

    def __init__(self, rows: DataFrame) -> None:
        ingest.require(rows, ["user_id", "obs"])
        self.rows = rows

    @classmethod
    def from_table(cls, df: DataFrame, *, user_col: str, cost_cols: list[str], action_cols: list[str], time_col: str | None = None, period_col: str | None = None) -> Panel:
        """From a wide table; with ``period_col`` each user has an entry "user__period" for each period."""
        if not period_col:
            return cls(ingest.from_wide(df, user_col=user_col, cost_cols=cost_cols, action_cols=action_cols, time_col=time_col))
        keyed = df.withColumn("__entry", F.concat_ws("__", F.col(user_col).cast("string"), F.col(period_col).cast("string")))
        return cls(ingest.from_wide(keyed, user_col="__entry", cost_cols=cost_cols, action_cols=action_cols, time_col=time_col).withColumn("period", F.substring_index("user_id", "__", -1)))

    def users(self) -> DataFrame:
        return self.rows.select("user_id").distinct()

    def periods(self) -> DataFrame:
        if "period" not in self.rows.columns:
            raise errors.FormatError("the panel has no periods")
        return self.rows.select("period").distinct()

    def of_period(self, period: str) -> Panel:
        return Panel(self.rows.filter(F.col("period") == period))

    def filter(self, condition: Column) -> Panel:
        """Users whose row meets a condition on user_id and obs."""
        return Panel(self.rows.filter(condition))

    def windows(self, size: int) -> Panel:
        """Entries of ``size`` observations in a row; windows of less than two go."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("obs") - 1) / size)), lambda k: F.slice("obs", (k * size + 1).cast("int"), F.lit(size)))
        rows = self.rows.select("user_id", F.posexplode(parts).alias("w", "obs")).filter(F.size("obs") >= 2)
        return Panel(rows.select(F.concat_ws("__", "user_id", F.col("w").cast("string")).alias("user_id"), "obs", F.col("w").cast("string").alias("period")))

    def score(self, metrics=METRICS) -> DataFrame:
        return score.score_budget(self.rows, metrics)

    def summary(self) -> DataFrame:
        return reports.summary(score.score_budget(self.rows, ("garp",)))


class MenuPanel(Panel):
    """Menu rows (user_id, obs)."""

    @classmethod
    def from_table(cls, df: DataFrame, *, user_col: str, menu_col: str = "menu", choice_col: str = "choice", time_col: str | None = None) -> MenuPanel:
        return cls(ingest.from_menus(df, user_col=user_col, menu_col=menu_col, choice_col=choice_col, time_col=time_col))

    def score(self, count: str = "items") -> DataFrame:
        return score.score_menu(self.rows, count=count)

    def summary(self) -> DataFrame:
        s = self.score()
        mean = lambda c: F.avg(F.col(c).cast("double")).alias(f"share_{c[3:]}")
        return s.agg(F.count(F.lit(1)).alias("n_users"), mean("is_sarp"), mean("is_warp"), mean("is_warp_la"), F.avg(F.col("hm_consistent") / F.col("hm_total")).alias("mean_hm"))


class Auditor:
    """Reports of consistency for every user of a panel."""

    def __init__(self, simulations: int = 200, seed: int = 42) -> None:
        self.simulations, self.seed = simulations, seed

    def audit(self, panel: Panel) -> DataFrame:
        """Verdict, integrity (ccei) and confusion (mpi)."""
        return reports.audit(score.score_budget(panel.rows, ("garp", "ccei", "mpi")))

    def scores(self, panel: Panel) -> DataFrame:
        """One number from 0 to 1 of each user: the mean of integrity and of one less confusion."""
        return self.audit(panel).select("user_id", ((F.col("integrity") + 1 - F.least(F.lit(1.0), F.col("confusion"))) / 2).alias("score"))

    def details(self, panel: Panel) -> DataFrame:
        """All metrics and the variants of the test."""
        return panel.score().join(score.score_variants(panel.rows), "user_id")

    def power(self, panel: Panel) -> DataFrame:
        return inference.power(panel.rows, self.simulations, seed=self.seed)

    def granular(self, panel: Panel, threshold: float = 0.9) -> DataFrame:
        """Efficiency of every observation, and whether it falls below the threshold."""
        from concordia.operators import budget

        worst = budget.edges(panel.rows, 1e-8).groupBy("user_id", "i").agg(F.max(F.when(F.col("r"), F.col("e") / F.col("own"))).alias("x"))
        fine = score.score_budget(panel.rows, ("garp",)).select("user_id", "is_garp")
        level = F.when(F.col("is_garp"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("x", F.lit(0.0))))
        return worst.join(fine, "user_id").select("user_id", "i", level.alias("efficiency"), (level < threshold).alias("is_low"))

    def menus(self, panel: MenuPanel) -> DataFrame:
        s = panel.score(count="observations")
        return s.select("user_id", "is_sarp", "is_warp", (F.col("hm_consistent") / F.col("hm_total")).alias("efficiency"))


class Encoder:
    """Users as vectors of their scores, for models elsewhere."""

    def __init__(self, metrics=METRICS) -> None:
        self.metrics = score.check_metrics(metrics)

    def transform(self, panel: Panel) -> DataFrame:
        """user_id and features: all numeric columns of the scores and statistics of the recovered utility."""
        s = score.score_budget(panel.rows, self.metrics).drop("compute_time_us")
        u = structure.utilities(panel.rows).groupBy("user_id").agg(F.avg("utility").alias("u_mean"), F.stddev_pop("utility").alias("u_std"), F.avg("multiplier").alias("m_mean"), F.stddev_pop("multiplier").alias("m_std"))
        rows = s.join(u, "user_id", "left")
        names = [c for c in rows.columns if c != "user_id"]
        return rows.select("user_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("features"))

    def status(self, panel: Panel) -> DataFrame:
        """Whether a utility could be recovered for each user."""
        fitted = score.score_budget(panel.rows, ("garp", "utility")).select("user_id", F.col("utility_success").alias("is_fitted"))
        return fitted.withColumn("status", F.when(F.col("is_fitted"), "optimal").otherwise("inconsistent"))

    def values(self, panel: Panel) -> DataFrame:
        """Recovered utility and multiplier of each observation."""
        return structure.utilities(panel.rows)

    def predict(self, panel: Panel, prices: list[float], wealth: float) -> DataFrame:
        return structure.demand_at(panel.rows, prices, wealth)


def filter_users(panel: Panel, keep: Callable[[Column], Column]) -> Panel:
    """Users for whom ``keep`` holds of their array of observations."""
    return panel.filter(keep(F.col("obs")))
