"""Training-data operators over documents, vectors and pages; nothing outside this subpackage imports it."""
