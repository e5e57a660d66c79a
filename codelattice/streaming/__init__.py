"""Incremental dataflow: debounced changes, staging overlay, promotion of micro-batches."""
