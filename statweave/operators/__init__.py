"""Relational operators over triples, vectors, graphs, results and annotations."""
