"""Table scans, log files, and the export sinks."""
