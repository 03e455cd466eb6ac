"""Clinical knowledge-retrieval analytics and training-data operators on Spark."""
