"""Training-data operators over documents, pages and embeddings (a removable subpackage)."""
