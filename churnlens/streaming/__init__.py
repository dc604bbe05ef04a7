"""Incremental scoring (the batch scoring step, run as new files arrive)."""

from churnlens.streaming.scoring import start_scoring  # noqa: F401
