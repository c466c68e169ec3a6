"""Readers and writers: rosters, click logs, link files, articles, reports, databases."""
