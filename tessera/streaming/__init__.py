"""Epochs: stream relations, delays and changes, in batches and on Structured Streaming."""

from .epochs import delayed, differentiate, epoch_rows, run_epochs, stream_transform

__all__ = ["delayed", "differentiate", "epoch_rows", "run_epochs", "stream_transform"]
