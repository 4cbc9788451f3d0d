"""Operators for training data: percentiles, token ids, mixes, shared stretches. Nothing outside this folder imports it."""
