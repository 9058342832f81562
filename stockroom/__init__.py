"""stockroom: product-catalogue analytics expressed as Spark plans."""
