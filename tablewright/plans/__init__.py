"""Plan helpers: written intermediate tables and named-step pipelines."""
