"""Where corpora come from and how indexes are stored."""
