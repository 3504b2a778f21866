"""Whole plans: from URLs and captures to evidence, reports and rejects."""
