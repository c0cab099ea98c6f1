"""Scans: landed provider pages, the label index, image files, the manifest."""
