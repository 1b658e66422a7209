"""Spatial-transcript analytics and corpus preparation as plain PySpark DataFrame functions."""
