"""tallyframe: count featurization for supervised learning, as Spark plans."""
