"""Queries that apply the engine's operators to the driver's tables, with their oracles."""
