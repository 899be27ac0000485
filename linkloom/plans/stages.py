"""User stages: named steps from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Stage:
    """One step; ``apply`` takes and returns a DataFrame."""

    apply: Callable[[DataFrame], DataFrame]
    name: str = "default"


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Chain the stages into one lazy plan; an error names the stage it came from."""
    for stage in stages:
        try:
            df = df.transform(stage.apply)
        except Exception as error:
            error.add_note(f"in stage {stage.name!r}")
            raise
    return df
