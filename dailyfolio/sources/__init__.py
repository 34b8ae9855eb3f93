"""Landing-file readers, update feed and table store."""
