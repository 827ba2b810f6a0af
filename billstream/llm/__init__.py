"""Training-data operators over document and embedding tables."""
