"""Operators over DataFrames: vector search, bank policies, matching, geometry, masks, metrics, protocols."""
