"""DataFrame operators: cell-matrix algebra, reshaping, weights, ranking."""
