"""Streams: live journals and readiness."""
