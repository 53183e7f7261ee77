"""graniq: a Spark-native retrieval and record-intelligence engine."""
