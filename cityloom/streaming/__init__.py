"""Tables kept current from incoming files with Structured Streaming."""
