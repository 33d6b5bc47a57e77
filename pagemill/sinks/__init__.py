"""Writers of documents and files."""
