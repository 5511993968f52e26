"""Registered queries with their SQL."""

from __future__ import annotations

from . import models, sound, statistics, study
from .registry import ORACLES, QUERIES

MODULES = (sound, study, statistics, models)


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict:
    return dict(ORACLES)
