"""Structured Streaming forms of the gate, the match and the feedback loop."""
