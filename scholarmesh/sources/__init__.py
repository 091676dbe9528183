"""Readers of announcement pages, snapshots, documents and web pages; writers of results and dumps."""
