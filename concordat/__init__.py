"""Record reconciliation on Spark: matching of estimate positions and counterparty requisites, and review of the findings."""
