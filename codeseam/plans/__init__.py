"""Driver-side planning: query strings and patterns become Columns and joins."""
