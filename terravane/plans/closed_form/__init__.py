"""SQL over the closed form of the synthetic terrain: the answers that the registered queries are held against."""
