"""Files, converters, configuration and evaluation cases; output lines."""
