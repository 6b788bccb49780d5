"""sievework: contract-checked layers, exact rankings and their statistics on Spark."""
