"""Sources and sinks (S1..S15)."""
