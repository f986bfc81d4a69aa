"""Steps of a training-data pipeline: each module is one operator over a table of documents or pages."""
