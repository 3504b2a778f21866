"""Stateless streams over captured pages."""
