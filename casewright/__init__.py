"""Production-operations analytics for made-to-order labs, expressed as Spark DataFrame operators."""
