"""terravane: terrain analytics and corpus preparation as DataFrame programs."""

__version__ = "0.1.0"
