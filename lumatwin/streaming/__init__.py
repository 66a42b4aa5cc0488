"""The incremental operators as streams."""
