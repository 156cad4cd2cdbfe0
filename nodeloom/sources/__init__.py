"""Text edge-list readers and delimited-text sinks."""
