"""weftline: entity consolidation on Spark, expressed as DataFrame plans."""
