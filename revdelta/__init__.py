"""Revision analytics over tables of documents, pages, text items and rasters."""

__version__ = "0.1.0"
