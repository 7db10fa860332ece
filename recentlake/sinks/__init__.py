"""Writers for the lake, reports and Kafka rows."""
