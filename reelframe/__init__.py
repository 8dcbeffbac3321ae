"""Spark-native operators for media relations: frames, samples, cues, segments, renditions."""
