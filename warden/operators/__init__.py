"""Gates, decisions, learning, policy, audit: DataFrame to DataFrame."""
