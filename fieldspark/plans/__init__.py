"""Model plans: statistics, fitting, prediction."""
