"""tessera: Spark-first operators for evaluation tables, masks, manifests and experiments."""
