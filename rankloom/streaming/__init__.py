"""Structured Streaming: request streams scored against static index tables."""
