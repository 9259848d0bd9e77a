"""Readers and writers: raw posts, tagged posts, cluster centres, staged tables."""
