"""Analytics over synthetic populations and their geography, as Spark DataFrame operators."""
