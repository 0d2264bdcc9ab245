"""Column expressions of the scan: text, entropy, context signals, severity."""
