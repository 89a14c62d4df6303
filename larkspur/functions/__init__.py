"""Losses and metrics as column expressions and aggregates."""
