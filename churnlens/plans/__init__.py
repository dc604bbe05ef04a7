"""Model pipelines, tuning, selection sweeps, stacking and the registered queries."""
