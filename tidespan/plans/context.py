"""The domain on the test tables: which columns are records, reads, status samples and groups."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.operators import carve, cycles, survival
from tidespan.operators.carve import Rung

LADDER = [Rung("r20", 20.0), Rung("r50", 50.0), Rung("r100", 100.0)]
GAP_MULT = 4.0
SPACING_S = 43_200.0
STATUS = {"error": "offline", "click": "calibrating", "view": "measuring", "signup": "idle", "purchase": "tuning"}


class Context:
    """Lazy DataFrames over one folder of tables; nothing here runs a job."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events_raw(self) -> DataFrame:
        t = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.table("events").select(F.col("user_id").alias("record"), t.alias("t_us"), F.col("event_id").alias("seq"), "value", "event_type")

    @cached_property
    def reads(self) -> DataFrame:
        sigma = F.when(F.col("seq") % 7 != 0, 0.1 * F.col("value"))
        return self.events_raw.select("record", "t_us", "seq", "value", sigma.alias("sigma"))

    @cached_property
    def ladder(self) -> DataFrame:
        return carve.ladder_frame(self.spark, LADDER)

    @cached_property
    def obs(self) -> DataFrame:
        return carve.observed_reads(self.reads, GAP_MULT)

    @cached_property
    def rows(self) -> DataFrame:
        return carve.threshold_reads(self.obs, self.ladder)

    @cached_property
    def wins(self) -> DataFrame:
        return carve.windows(self.rows)

    @cached_property
    def events(self) -> DataFrame:
        return survival.event_table(self.wins)

    @cached_property
    def curve(self) -> DataFrame:
        """Curves of each rung and side over all records."""
        return survival.product_limit(survival.risk_table(self.events, ("label", "side"), pooled=True), ("label", "side"), pooled=True)

    @cached_property
    def record_curve(self) -> DataFrame:
        return survival.product_limit(survival.risk_table(self.events))

    @cached_property
    def samples(self) -> DataFrame:
        names = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
        return self.events_raw.select("record", "t_us", "seq", F.coalesce(names[F.col("event_type")], F.lit("other")).alias("status"))

    @cached_property
    def spells(self) -> DataFrame:
        return cycles.spells(self.samples, SPACING_S)

    @cached_property
    def live(self) -> DataFrame:
        return cycles.stretches(self.spells)

    @cached_property
    def groups(self) -> DataFrame:
        """The group of each record: a dimension of one row a record."""
        return self.events_raw.select("record").distinct().select("record", F.concat(F.lit("g"), (F.col("record") % 4).cast("string")).alias("grp"))
