"""Fixed schemas of the engine's stored tables."""

DEFS = "path string, name string, kind string, container string, line int, text string"
DELTA = "path string, deleted boolean, seq long, size long, mtime_ns long, text string"
