"""Artifacts from result tables: TSV, diagrams, Markdown, SARIF, treemap and JSON. Rows are made by plans; texts of bounded size are put together on the driver."""
