"""Search, graph, index, evaluation and analytics operators."""
