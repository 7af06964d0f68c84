"""postbag: analytics over message archives, written for Spark."""
