"""Steps of the training job, each usable on its own."""
