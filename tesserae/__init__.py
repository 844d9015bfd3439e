"""Label-volume and graph-partition analytics expressed as Spark plans."""
