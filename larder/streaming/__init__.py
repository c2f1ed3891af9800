"""Structured Streaming forms of the intake, plate and sync operators."""
