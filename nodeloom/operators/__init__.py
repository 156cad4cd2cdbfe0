"""DataFrame-to-DataFrame operators: edges, degrees, bins, ranks, triangles, matrices."""
