"""The operators bound to the test tables: one Spark query and, where SQL can say it, one
independently written SQL text per name."""
