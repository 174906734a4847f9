"""Query catalogue: every query with its plan and, where SQL can say it, its oracle."""
