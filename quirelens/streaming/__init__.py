"""Kept empty on purpose: the workload covered here has no stream, watermark or
session window, so there is nothing to express with Structured Streaming."""
