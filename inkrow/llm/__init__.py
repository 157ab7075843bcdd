"""Operators of a training-data pipeline: language, quality, copies, tokens, archives."""
