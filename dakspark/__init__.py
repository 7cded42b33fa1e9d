"""dakspark: a Spark-native engine for matching, cleaning and verifying postal addresses."""
