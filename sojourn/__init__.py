"""Spark-native analytics over keyed date intervals that arrive late, dirty and more than once."""
