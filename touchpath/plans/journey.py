"""The journey model: facts and shared intermediates of all waves, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpath import constants as K
from touchpath import schemas
from touchpath.operators import attribution as A
from touchpath.operators import quality as Q
from touchpath.operators.cleaning import RULES, CleaningRules, clean_conversions, clean_touches
from touchpath.operators.windows import period_bounds, validity_windows
from touchpath.sources.files import write_parquet


@dataclass(frozen=True)
class JourneyConfig:
    """Everything that changes results, in one place."""

    waves: tuple[str, ...]
    last_touch_days: int = K.LAST_TOUCH_DAYS
    priority: Mapping[str, int] = field(default_factory=lambda: dict(K.CHANNEL_PRIORITY))
    cap_all: bool = False
    tie_policy: str = "priority"
    tie_count: str = "touches"
    rules: CleaningRules = RULES


class Journey:
    """Touches, conversions and what follows from them. Nothing runs until an action.

    Every frame carries ``wave``, so all waves are computed together. For more
    than one report on large data call :meth:`materialize` once and work on
    the model it returns: the attribution is then read instead of recomputed.
    """

    def __init__(self, touches: DataFrame, conversions: DataFrame, config: JourneyConfig) -> None:
        self.touches = schemas.require(touches, schemas.TOUCHES, "touches")
        self.conversions = schemas.require(conversions, schemas.CONVERSIONS, "conversions")
        self.config = config
        self._raw: tuple[DataFrame, DataFrame] | None = None
        self.verdicts: list[Q.WaveVerdict] = []

    @classmethod
    def from_raw(cls, touches: DataFrame, conversions: DataFrame, config: JourneyConfig) -> Journey:
        """Model over raw text rows that carry a ``wave`` column."""
        model = cls(
            clean_touches(touches, rules=config.rules),
            clean_conversions(conversions, rules=config.rules),
            config,
        )
        model._raw = touches, conversions
        return model

    @cached_property
    def owners(self) -> DataFrame:
        c = self.config
        return A.conversion_owners(
            self.touches, self.conversions, c.last_touch_days, c.priority, c.cap_all, c.tie_policy
        )

    @cached_property
    def attribution(self) -> DataFrame:
        return A.attribution_detail(self.owners, self.config.tie_count)

    @cached_property
    def windows(self) -> DataFrame:
        return validity_windows(self.touches, self.config.last_touch_days, self.config.cap_all)

    @cached_property
    def period(self) -> DataFrame:
        return period_bounds(self.touches, self.conversions)

    def materialize(self, path: str, gates: bool = True) -> Journey:
        """Write clean facts and owners to ``path`` (shared storage) and read them back.

        Rows read, rows kept, reached and attributed conversion days are counted per wave of the configuration while they
        are written, by observation: no scan and no job of their own. With ``gates``, a wave that cleaning empties, or of
        which nothing meets or is attributed, raises ``QualityError``; the counts stay in ``verdicts``.
        """
        spark, waves = self.touches.sparkSession, self.config.waves
        seen = {name: Observation() for name in ("touches_read", "touches_valid", "conversions_read", "conversions_valid")}
        for name, clean in (("touches", clean_touches), ("conversions", clean_conversions)):
            if self._raw is None:
                del seen[f"{name}_read"]
                df = getattr(self, name)
            else:
                raw = self._raw[name == "conversions"]
                df = clean(raw.observe(seen[f"{name}_read"], *Q.per_wave(waves)), rules=self.config.rules)
            write_parquet(df.observe(seen[f"{name}_valid"], *Q.per_wave(waves)), f"{path}/{name}", [K.WAVE])
        for name in ("touches", "conversions"):  # a model of clean facts reads what it keeps
            seen.setdefault(f"{name}_read", seen[f"{name}_valid"])
        if gates:
            Q.require_passed(Q.verdicts(waves, seen))
        stored = self.read(spark, path, self.config, with_owners=False)
        seen |= {"reached": Observation(), "attributed": Observation()}
        owners = stored.owners.observe(seen["reached"], *Q.per_wave(waves, F.col("impactado")))
        owners = owners.observe(seen["attributed"], *Q.per_wave(waves, F.col("toque").isNotNull()))
        write_parquet(owners, f"{path}/owners", [K.WAVE])
        model = self.read(spark, path, self.config)
        model.verdicts = Q.verdicts(waves, seen)
        if gates:
            Q.require_passed(model.verdicts)
        return model

    @classmethod
    def read(
        cls, spark: SparkSession, path: str, config: JourneyConfig, with_owners: bool = True
    ) -> Journey:
        """Model over the tables :meth:`materialize` wrote."""

        def table(name: str) -> DataFrame:
            found = spark.read.parquet(f"{path}/{name}").schema
            # Partition values are text, whatever they look like.
            text_wave = [T.StructField(f.name, T.StringType()) if f.name == K.WAVE else f for f in found]
            return spark.read.schema(T.StructType(text_wave)).parquet(f"{path}/{name}")

        model = cls(table("touches"), table("conversions"), config)
        if with_owners:
            model.owners = table("owners")
        return model
