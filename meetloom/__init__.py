"""Schedule consolidation jobs for many meetings and inboxes, as PySpark DataFrame code."""
