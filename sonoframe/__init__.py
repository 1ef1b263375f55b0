"""Signal and table analytics on Spark."""
