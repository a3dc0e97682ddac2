"""gridlens: smart-meter load analytics written as Spark DataFrame jobs."""
