"""strataq: a DataFrame-first engine for building, searching and measuring a document knowledge base."""
