"""Readers and writers: XML, JSON, text, bank CSV, ledger CSV."""
