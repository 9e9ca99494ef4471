"""Writers (K1-K4)."""

from tmweave.sinks.tables import (  # noqa: F401
    start_executions, write_outbox, write_tm, write_translated,
)
