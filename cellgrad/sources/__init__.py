"""Sources and sinks: driver tables as training fixtures, CSV feature files,
literal matrices, result logs, the discard sink."""
