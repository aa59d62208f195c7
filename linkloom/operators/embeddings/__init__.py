"""Node embedding families."""
