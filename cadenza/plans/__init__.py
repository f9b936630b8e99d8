"""The registered queries: what each computes over the driver's tables, beside SQL that says the same."""
