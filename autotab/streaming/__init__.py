"""Applying fitted models to streams."""

from autotab.streaming.score import read_stream, score_stream  # noqa: F401
