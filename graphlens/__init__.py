"""graphlens: a Spark-native analytics engine for labelled graphs and model-score evaluation."""
