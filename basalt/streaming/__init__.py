"""Event-time operators for batches and streams.

The same functions take a batch or a stream; on a stream a watermark bounds the
state, and rows later than it are left out.
"""
