"""auditloom: audit-event analytics and training-data preparation on PySpark."""
