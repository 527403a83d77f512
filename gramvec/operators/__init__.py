"""DataFrame operators of the pipeline (preprocessing, sampling, batching, model)."""
