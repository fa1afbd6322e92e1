"""Event-level risk analysis on wide fact tables, as Spark DataFrame operators."""

from sparkrisk.spec import ENCOUNTERS, EncounterSpec

__all__ = ["ENCOUNTERS", "EncounterSpec"]
