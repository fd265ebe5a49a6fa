"""Readers of uploads and crawl files, and the crawl over a table of pages."""
