"""Streams of messages: batches one after another instead of a table at rest."""
