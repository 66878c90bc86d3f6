"""stockweave: supply-chain planning and training-data preparation on Spark."""
