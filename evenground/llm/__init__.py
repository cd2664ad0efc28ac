"""Training-data operators: ten text and vector jobs over the tables documents, pages, conversations, embeddings."""
