"""Sources and sinks: files on disk, exported pull-request records, diffs, payloads."""
