"""Sources and sinks S1-S11."""
