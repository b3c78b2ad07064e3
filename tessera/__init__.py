"""tessera: a PySpark-native engine for scoring, labelling and evaluating code and text records."""
