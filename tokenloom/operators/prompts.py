"""Prompt registries as tables of profile, name and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import checks

SLOTS = 128


def of_profile(prompts: DataFrame, profile: str, source: DataFrame | None = None) -> DataFrame:
    """name and slot of a profile; an error if it is unknown, or if source (name, slot) differs from the registry's."""
    if source is not None:
        checks.strict(checks.same_dictionary(source, prompts.where(F.col("profile") == "source")), "the source dictionary differs")
    found = prompts.where((F.col("profile") == profile) & (F.col("profile") != "source"))
    if found.isEmpty():
        raise ValueError(f"no such profile: {profile}")
    return found.select("name", "slot")


def unused_slots(prompts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """profile and slot of the slots that no name of a profile has."""
    every = prompts.select("profile").distinct().select("profile", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return every.join(prompts.select("profile", "slot"), ["profile", "slot"], "left_anti")


def aliases(prompts: DataFrame) -> DataFrame:
    """profile, slot, n_names and names (sorted, comma-joined) of the slots in use."""
    return prompts.groupBy("profile", "slot").agg(F.count("*").alias("n_names"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
