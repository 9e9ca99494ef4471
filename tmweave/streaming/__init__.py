"""Structured Streaming forms of admission (R1), TM ingest (R2) and combine."""

from tmweave.streaming.jobs import (  # noqa: F401
    read_admissions, run_available_now, stream_admission, stream_admission_from_events,
    stream_admission_live, stream_combine, stream_tmx,
)
