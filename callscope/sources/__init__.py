"""Reading and writing of manifests, blobs, tables and archives."""
