"""Input contracts, parquet loaders and the fixture adapters."""
