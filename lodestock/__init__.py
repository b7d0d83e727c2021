"""lodestock: catalog retrieval and corpus preparation as Spark plans."""
