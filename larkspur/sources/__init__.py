"""Sources: files, histories, structured files, reports and driver tables as lines."""
