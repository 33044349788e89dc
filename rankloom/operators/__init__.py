"""Relational operators over DataFrames: lexical, dense, fusion, diversity, filters,
rankings, metrics and page processing."""
