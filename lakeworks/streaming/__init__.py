"""Streams: continuous append, and the hand-over from a batch backfill."""
