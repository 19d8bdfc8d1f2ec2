"""Reading and writing images, labels, features, models and results."""
