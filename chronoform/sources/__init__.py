"""Reading and writing evidence: JSON, logs, files, catalogs, append-only tables."""
