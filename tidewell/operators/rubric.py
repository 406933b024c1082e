"""Ratings of posts: statuses of measures and traffic lights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status(value: Column, good: float, warn: float) -> Column:
    """QLT-01: good or warn from that much on, else poor."""
    return F.when(value >= good, "good").when(value >= warn, "warn").otherwise("poor")


def medical_light(consensus_serious: Column, single_serious: Column, findings: Column) -> Column:
    """QLT-02: red if an agreed finding is serious, yellow if there is any finding at all."""
    return F.when(consensus_serious > 0, "red").when((single_serious > 0) | (findings > 0), "yellow").otherwise("green")


def seo_light(critical: Column, poor: Column, warn: Column, serious: Column) -> Column:
    """QLT-02: from the numbers of critical, poor and warning measures and of serious findings."""
    return F.when((critical > 0) | (poor >= 2) | (serious >= 3), "red").when((poor >= 1) | (warn >= 3) | (serious >= 1), "yellow").otherwise("green")
