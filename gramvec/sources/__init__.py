"""Sources and sinks: corpus scans, batch files, model tables."""
