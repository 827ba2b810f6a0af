"""Micro-batch intake on Structured Streaming."""
