"""tablewright: model quality, lineage, profiling and corpus preparation as Spark DataFrame operators."""
