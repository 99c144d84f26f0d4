"""Files, messages and remote batches."""
