"""Plan building blocks shared by the operators: staging, positions, frames, quantiles."""
