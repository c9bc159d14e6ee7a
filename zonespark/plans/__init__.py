"""Configuration, orchestration and the helpers that cut lineage."""
