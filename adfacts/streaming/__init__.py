"""The per-row rules on a stream of ads."""
