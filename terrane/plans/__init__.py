"""What shapes plans: results stored to cut lineage."""
