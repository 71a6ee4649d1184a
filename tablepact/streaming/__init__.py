"""Contract validation of a stream, one run per micro-batch."""

from tablepact.streaming.micro_batch import validate_stream

__all__ = ["validate_stream"]
