"""Part of clausecut."""
