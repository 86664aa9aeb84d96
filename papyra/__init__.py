"""papyra: document analytics on Spark."""
