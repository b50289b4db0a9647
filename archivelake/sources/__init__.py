"""Scans of folders, images and tables, and the snapshot store."""
