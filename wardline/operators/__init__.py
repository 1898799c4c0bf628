"""DataFrame -> DataFrame operators of the cohort workflow."""
