"""Column functions: time grid, text, error rules, payload access."""
