"""panelcast: forecasting panels (many series x time) as Spark DataFrames."""
