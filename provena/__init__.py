"""provena: component-provenance analytics expressed as Spark DataFrames."""
