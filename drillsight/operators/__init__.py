"""Operators on recipients, campaigns, links and click events."""
