"""Rule compilation and run assembly (findings, runs)."""
