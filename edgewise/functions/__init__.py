from .columns import (array_add, array_axpy, array_dot, edge_set_fingerprint, expr, hash_uniform,
                      undirected)

__all__ = ["array_add", "array_axpy", "array_dot", "edge_set_fingerprint", "expr",
           "hash_uniform", "undirected"]
