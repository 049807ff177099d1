"""Spark jobs for medical-image collections."""
