"""panelkit: governed, reproducible tabular pipelines declared on Spark DataFrames."""
