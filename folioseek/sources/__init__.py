"""Word-processor files, file listings, text tables and stored indexes."""
