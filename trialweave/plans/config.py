"""What an experiment is configured with."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExperimentConfig:
    """Options of a batch of trials; ``None`` means that an option wasn't given."""

    inputs: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    text_file: str | None = None
    silence_sec: float = 15.0
    seeds: str | None = None
    num_trials: int | None = None
    model: str = "echo"
    device: str = "cpu"
    half: bool = False
    temp: float | None = None
    temp_text: float | None = None
    cfg_coef: float | None = None
    max_gen_sec: float = 60.0
    response_sec: float = 10.0
    tts_voice: str | None = None
    tts_rate: int = 200
    tts_speed: float = 1.25
    frame_rate: float = 12.5
    sample_rate: int = 24000
    acoustic_delay: int = 2

    @property
    def frame_size(self) -> int:
        return int(self.sample_rate / self.frame_rate)

    def as_json(self) -> str:
        """All options by name, those not given as null."""
        return json.dumps(asdict(self))

    def seed_list(self) -> list[int]:
        """``seeds`` even if it lists none, else 0 to ``num_trials`` - 1, else just 0; a seed that is no number raises."""
        if self.seeds is not None:
            return [int(x) for x in self.seeds.split(",") if x.strip()]
        return [0] if self.num_trials is None else list(range(self.num_trials))


def first_given(*options: Column, default: Column | None = None) -> Column:
    """The first option that was given, as a model may have it under several names; else the default, or null."""
    return F.coalesce(*options, default if default is not None else F.lit(None))


def run_records(runs: DataFrame, config: ExperimentConfig) -> DataFrame:
    """``runs`` (started, a timestamp, and any others) with what a run is remembered by.

    These are model, datetime (to the second), args (all options as JSON), frame_rate, sample_rate, acoustic_delay, and the
    options temp, temp_text and cfg_coef, null where they weren't given.
    """
    given = lambda name: F.lit(getattr(config, name)).cast("double").alias(name)
    return runs.select(
        "*", F.lit(config.model).alias("model"), F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), F.lit(config.as_json()).alias("args"), F.lit(config.frame_rate).alias("frame_rate"),
        F.lit(config.sample_rate).cast("long").alias("sample_rate"), F.lit(config.acoustic_delay).cast("long").alias("acoustic_delay"), given("temp"), given("temp_text"), given("cfg_coef"),
    )
