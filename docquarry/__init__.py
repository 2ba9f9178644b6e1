"""docquarry: document-corpus analytics expressed as Spark plans."""
