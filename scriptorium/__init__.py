"""Scriptorium: mention mining and citation-network analytics expressed as Spark plans."""
