"""Training-data operators: each module holds one operator over documents, pages or conversations."""
