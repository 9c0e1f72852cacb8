"""earshot: audience-feedback analytics expressed as Spark plans."""
