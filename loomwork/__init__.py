"""Network, discussion and data-quality analytics as DataFrame-to-DataFrame operators on Spark."""
