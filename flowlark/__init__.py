"""flowlark: flow analytics expressed as Spark DataFrame plans."""
