"""scriptorium: relational structuring, scoring and audit of long-form documents on Spark."""
