"""linkspark: Spark-first business entity resolution, plus the text tools in linkspark.llm."""
