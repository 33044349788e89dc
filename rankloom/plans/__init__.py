"""Composite jobs: index build, retrieve, recommend, evaluate, predict, catalog build."""
