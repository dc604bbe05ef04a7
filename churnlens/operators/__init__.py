"""DataFrame operators of the churn workflow."""
