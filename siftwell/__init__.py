"""Siftwell: page-audit evidence and corpus processing as Spark DataFrame operators."""
