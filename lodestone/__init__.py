"""lodestone: corpus, audit and design analytics expressed as Spark DataFrame plans."""
