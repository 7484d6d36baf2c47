"""Structured Streaming: debounced batches, merges and deltas by batch, event-time windows, logical clocks."""
