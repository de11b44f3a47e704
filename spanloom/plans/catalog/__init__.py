"""Registered queries, each with the survey ids it covers and, where SQL can say it, equivalent SQL."""

from . import alerting, events, query_layer, rollups, streams, texts
from .registry import ENTRIES

__all__ = ["ENTRIES", "alerting", "events", "query_layer", "rollups", "streams", "texts"]
