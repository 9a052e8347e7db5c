"""Operators for preparing large text corpora; standalone within the library."""
