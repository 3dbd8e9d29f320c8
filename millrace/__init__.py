"""millrace: event-stream analytics and corpus preparation on PySpark."""
