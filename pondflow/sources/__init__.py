"""Sources (CSV readings, driver tables) and sinks."""
