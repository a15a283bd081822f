"""Quillstone: evidence analytics as PySpark DataFrame operators."""
