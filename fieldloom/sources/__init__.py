"""Readers and writers for documents, labels, reports and rename ledgers."""
