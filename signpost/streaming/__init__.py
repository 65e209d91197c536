"""Routing of article streams."""
