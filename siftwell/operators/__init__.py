"""Operators over DataFrames: parsing, links, evidence, rendering, blocks, scoring."""
