"""Index build, boolean evaluation, spelling correction and ranking, each a DataFrame to DataFrame function."""
