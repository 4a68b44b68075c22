"""Training-data operators: filters, classifiers, near-duplicate search, mixing and packing."""
