"""millrace: Spark-native curation and evaluation analytics for conversational text."""
