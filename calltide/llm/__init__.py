"""Operators for building training corpora: scoring, scanning, deduplicating, decontaminating, packing and archiving text."""
