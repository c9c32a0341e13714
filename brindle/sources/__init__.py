"""Sources and sinks: the key-value log."""
