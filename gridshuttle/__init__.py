"""Distributed multidimensional arrays in DataFrames: re-partitioning and Fourier-type transforms."""

from .config import Config
from .enums import *  # noqa: F403
from .errors import ErrorCode, GridError, error_string
from .plans.decomposition import Box
from .plans.plan import Plan, PlanC2C, PlanR2C, PlanR2R, Request

__version__ = "0.2.0"


def version(major: int | None = None, minor: int = 0, patch: int = 0) -> int:
    """The code of a version (of this one without arguments); later versions have greater codes."""
    if major is None:
        major, minor, patch = map(int, __version__.split("."))
    return (major * 100 + minor) * 100 + patch


__all__ = ["Box", "Config", "ErrorCode", "GridError", "Plan", "PlanC2C", "PlanR2C", "PlanR2R", "Request", "error_string", "version"]
