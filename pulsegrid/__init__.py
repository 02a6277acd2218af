"""Spark-native analytics over host telemetry: metrics, processes, events, alerts."""

from pulsegrid.session import build_session

__all__ = ["build_session"]
