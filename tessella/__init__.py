"""tessella: corpus analytics as lazy DataFrame-to-DataFrame operators on Spark."""
