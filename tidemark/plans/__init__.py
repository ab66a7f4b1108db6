"""Ready-made queries over the sample tables, each with an independent SQL twin."""
