"""storyflow: a Spark-native engine for news-style document streams."""
