"""patronlens: customer-360 and churn analytics for retail data, on Spark DataFrames."""
