"""Table readers, row ingestion and exporters."""
