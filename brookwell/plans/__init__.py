"""From a parsed query to a DataFrame."""
