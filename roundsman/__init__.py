"""Fleet-scale delivery-tour analytics written as Spark DataFrame operators."""
