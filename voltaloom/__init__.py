"""Analytics of long multichannel recordings on Spark."""

__version__ = "0.1.0"
