"""Streaming entry point: validate every micro-batch of a stream with the
batch rules (see ``micro_batch``)."""

from tessera.streaming.micro_batch import StreamValidator

__all__ = ["StreamValidator"]
