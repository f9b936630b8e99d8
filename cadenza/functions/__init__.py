"""Column functions: time slots, shrinkage, decay, and special functions that Spark lacks."""
