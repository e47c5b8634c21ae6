"""Replication lag over time, in batch and as streams, and state changes as a stream."""

from .changelog import state_from_changelog
from .lag import lag_series, sample_lag
from .throttle import lag_throttle
from .throttle_stream import lag_throttle_stream

__all__ = ["lag_series", "lag_throttle", "lag_throttle_stream", "sample_lag", "state_from_changelog"]
