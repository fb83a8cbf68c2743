"""Per-row logic. Everything here takes Columns and returns Columns."""
