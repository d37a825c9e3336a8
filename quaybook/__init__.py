"""Order-book event analytics on Spark: every computation is a DataFrame or SQL plan."""
