"""Driver-side plans: configuration, method selection, weights, pipelines and experiments."""
