"""Longitudinal-cohort analytics on Spark DataFrames."""

from cohortlens.config import RunConfig

__all__ = ["RunConfig"]
