"""Structured Streaming operators for incremental runs."""

from threadscope.streaming.incremental import (  # noqa: F401
    dedupe_stream,
    first_last_reply_stream,
    ingest_new_files,
    label_incremental,
    latest_first_last,
)
