"""Relational operators: change tracking, references, cleaning, retrieval, reports."""
