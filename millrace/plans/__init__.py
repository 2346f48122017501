"""From syntax trees to DataFrames, and what EXPLAIN says of them."""
