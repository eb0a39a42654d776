"""The short names: functions of the items or windows of one stream, or of several joined ones, as sinks.

Every one takes initial for a function with state, f(x, state) -> state, and honours step_size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from .core import OrderedStream
from .operators import sinks


def f_item(f: Callable, stream: OrderedStream, initial: Callable[[], object] | None = None) -> None:
    """f of each item."""
    sinks.sink_element(stream, f, initial)


def f_window(f: Callable, stream: OrderedStream, window_size: int, step_size: int = 1, initial: Callable[[], object] | None = None) -> None:
    """f of each window, a list."""
    sinks.sink_window(stream, window_size, step_size, f, initial)


def join_synch(f: Callable, streams: Sequence[OrderedStream], initial: Callable[[], object] | None = None) -> None:
    """f of the tuple of the streams' items at each position."""
    sinks.zip_map_sink(streams, f, initial)


def join_asynch(f: Callable, streams: Sequence[OrderedStream], order: str = "ts", initial: Callable[[], object] | None = None) -> None:
    """f of (stream number, item) as the items arrive."""
    sinks.join_asynch_sink(streams, f, order, initial, numbered=True)


def f_join_asynch(f: Callable, streams: Sequence[OrderedStream], order: str = "ts", initial: Callable[[], object] | None = None) -> None:
    """f of the items of all streams as they arrive, whichever they are from."""
    sinks.join_asynch_sink(streams, f, order, initial)


def join_timed(f: Callable, streams: Sequence[OrderedStream], time: str = "ts", initial: Callable[[], object] | None = None) -> None:
    """f of (time, [the streams' items at that time, or None])."""
    sinks.join_timed_sink(streams, f, time, initial)
