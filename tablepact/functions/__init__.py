"""SQL expression-text helpers (no actions, no UDFs); parse with ``F.expr``."""
