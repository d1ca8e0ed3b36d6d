"""Quillmark: corpus analytics as PySpark DataFrame operators."""
