"""The same rules on live streams."""
